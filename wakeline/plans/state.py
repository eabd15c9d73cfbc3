"""Queries of events, jobs and pointers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, keys
from ..operators import evidence, status, validate
from ..sources import snapshots
from ..streaming import ingest, lifecycle, transitions
from . import bindings as b

NOW = "2026-01-01 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


#: Types of job, with two that have no deadline of their own.
JOB_TYPES = ("installation.sync", "branch.reconcile", "branch.push", "pull_request.analyze", "report.deliver", "other")


def _jobs(spark, sf):
    """Events as jobs: the type is the event's, value and id tell status, attempts and lease."""
    e = b.table(spark, sf, "events")
    state = F.element_at(F.array(*map(F.lit, ("pending", "running", "completed", "running", "failed"))), (F.col("event_id") % 5 + 1).cast("int"))
    started = F.when(F.col("event_id") % 5 != 0, transitions.seconds_later(F.col("ts"), F.floor(F.col("event_id") % 90)))
    return e.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("job_type"), state.alias("status"), (F.col("event_id") % 4).cast("int").alias("attempts"), F.col("ts").cast("timestamp").alias("enqueued_at"), started.alias("first_started_at"),
        F.col("ts").cast("timestamp").alias("available_at"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("lease_token"),
        transitions.seconds_later(_now(), F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 600 + 1).otherwise(-(F.col("event_id") % 600) - 1)).alias("lease_expires_at"),
        F.lit(None).cast("timestamp").alias("terminal_at"), F.lit(None).cast("string").alias("last_error_kind"), "user_id", "value",
    )


def _plain(*names):
    """Timestamps without a zone, as the tables have them."""
    return [F.col(n).cast("timestamp_ntz").alias(n) for n in names]


def queue_health(spark, sf):
    return status.queue_health(_jobs(spark, sf), _now())


def recent_status(spark, sf):
    orders = b.table(spark, sf, "orders")
    analyses = orders.select(F.col("o_orderkey").alias("analysis_id"), F.col("o_custkey").alias("repo_id"), (F.col("o_orderkey") % 7).cast("int").alias("pull_request_number"), F.col("o_orderstatus").alias("analysis_status"), F.col("o_orderdate").alias("created_at"))
    reports = b.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("analysis_id")).agg(F.max("l_linestatus").alias("report_status"))
    deliveries = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("repo_id"), (F.col("c_custkey") % 7).cast("int").alias("pull_request_number"), F.col("c_mktsegment").alias("delivery_status"))
    return status.recent(analyses, reports, deliveries)


def stale_heads(spark, sf):
    e = b.table(spark, sf, "events")
    own = lambda kind, name: e.filter(F.col("event_type") == kind).groupBy("user_id").agg(F.max("event_id").alias(name))
    configs = e.select(F.col("user_id").alias("repo_id"), F.lit("main").alias("branch")).distinct()
    current = own("view", "current_sha").select(F.col("user_id").alias("repo_id"), F.lit("main").alias("branch"), F.col("current_sha").cast("string"))
    live = own("purchase", "live").select(F.col("user_id").alias("repo_id"), F.lit("main").alias("branch"), F.when(F.col("live") % 11 != 0, F.col("live").cast("string")).alias("live_sha"), F.when(F.col("live") % 11 == 0, "not found").alias("error"))
    return status.stale_branches(configs, current, live)


def _requests(spark, sf):
    e = b.table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("repo_id"), (F.col("event_id") % 3).cast("int").alias("pull_request_number"), F.col("event_id").alias("requested_at"),
        F.col("event_id").cast("string").alias("desired_analysis_id"), F.col("event_type").alias("desired_state"), F.format_string("%.2f", "value").alias("desired_head_sha"),
    )


def latest_pointer(spark, sf):
    return transitions.latest(_requests(spark, sf))


def undelivered(spark, sf):
    return transitions.undelivered(_undelivered_pointers(spark, sf)).select("repo_id", "pull_request_number", "desired_analysis_id")


def stale_job_skip(spark, sf):
    requests = _requests(spark, sf)
    jobs = requests.select(F.col("requested_at").alias("job_id"), "repo_id", "pull_request_number", F.col("desired_analysis_id").alias("analysis_id"), F.col("desired_head_sha").alias("head_sha"), F.col("desired_state").alias("state"))
    return transitions.stale(jobs, transitions.latest(requests))


def idempotent_ingest(spark, sf):
    e = b.table(spark, sf, "events")
    key = keys.idempotency_key((F.col("event_id") % 500).cast("string"), F.col("event_type"), F.lit(None).cast("string"), F.col("user_id") % 50, F.lit(None).cast("string"), F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 10))
    rows = e.select("event_id", "ts", key.alias("idempotency_key"))
    return ingest.once(rows, rows.filter("event_id % 10 = 0").select("idempotency_key"), "event_id")


def bucketed_dedupe(spark, sf):
    """Reconciliations asked for at each event, of which one for each branch, commit and five minutes stays."""
    e = b.table(spark, sf, "events").select((F.col("user_id") % 3).alias("repo_id"), F.lit("main").alias("branch"), F.col("event_type").alias("sha"), "ts", "event_id")
    asked = ingest.reconcile(e, F.col("ts"), "tracked")
    return asked.groupBy("repo_id", "branch", "sha", "job_type", "idempotency_key", "payload_sha256").agg(F.count("*").alias("n"))


def complete_jobs(spark, sf):
    """T4: the running jobs of even ids are completed by their lease's token."""
    jobs = _jobs(spark, sf)
    done = jobs.filter("status = 'running' and id % 2 = 0").select("id", F.col("lease_token").alias("token"))
    return transitions.complete(jobs, done, _now()).select("id", "status", *_plain("terminal_at"))


def superseded_pushes(spark, sf):
    """Each event pushes its own commit; a user's last one is the live head."""
    e = b.table(spark, sf, "events")
    pushes = e.select(F.col("user_id").alias("repo_id"), F.lit("main").alias("branch"), F.col("event_id").alias("after_sha"))
    heads = pushes.groupBy("repo_id", "branch").agg(F.max("after_sha").alias("live_sha"))
    return transitions.superseded(pushes, heads).select("repo_id", "after_sha")


def fenced_outcomes(spark, sf):
    """K7: outcomes of requests apply only where the pointer still desires that very request."""
    requests = _requests(spark, sf)
    null = [F.lit(None).cast("string").alias(f"last_delivered_{c}") for c in ("analysis_id", "head_sha", "state")]
    pointers = transitions.latest(requests).select("*", F.lit("pending").alias("status"), *null)
    told = requests.filter("requested_at % 2 = 0").select("repo_id", "pull_request_number", "desired_analysis_id", "desired_head_sha", "desired_state", F.when(F.col("requested_at") % 3 == 0, "failed").otherwise("delivered").alias("status"))
    return transitions.fenced(pointers, told).select("repo_id", "pull_request_number", "desired_analysis_id", "status", "last_delivered_analysis_id", "last_delivered_state")


def webhook_jobs(spark, sf):
    """Deliveries as JSON texts, routed against tracked branches."""
    e = b.table(spark, sf, "events")
    branch = F.when(F.col("event_id") % 3 == 0, "dev").otherwise("main")
    repo = F.struct(F.col("user_id").alias("id"), F.lit("main").alias("default_branch"))
    sha = F.when(F.col("event_id") % 10 == 0, F.lit("0" * 40)).otherwise(F.concat(F.lit("s"), F.col("event_id").cast("string")))
    push = F.to_json(F.struct(repo.alias("repository"), F.concat(F.lit("refs/heads/"), branch).alias("ref"), sha.alias("after")))
    request = F.struct(F.struct(branch.alias("ref")).alias("base"), F.struct(sha.alias("sha")).alias("head"), (F.col("event_id") % 100).alias("number"))
    pull = F.to_json(F.struct(F.when(F.col("event_id") % 5 == 0, "closed").otherwise("opened").alias("action"), repo.alias("repository"), request.alias("pull_request")))
    name = F.when(F.col("event_type") == "view", "push").when(F.col("event_type") == "click", "pull_request").otherwise("ping")
    deliveries = e.select(F.concat(F.lit("d"), F.col("event_id").cast("string")).alias("delivery_id"), name.alias("event_name"), F.when(name == "push", push).otherwise(pull).alias("body"))
    configs = e.select("user_id").distinct().filter("user_id % 4 < 2").select(F.col("user_id").alias("repo_id"), F.when(F.col("user_id") % 8 < 4, "dev").otherwise("main").alias("tracked_branch"), (F.col("user_id") % 4 == 0).alias("is_active"))
    return ingest.route(deliveries, configs).select("delivery_id", "repo_id", "pull_request_number", "sha", "job_type", "idempotency_key")


def account_upsert(spark, sf):
    """K6, K2: customers of even keys are known, those of keys not divisible by three come again with new values."""
    c = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("repo_id"), F.col("c_mktsegment").alias("name"), (F.col("c_custkey") % 5 == 0).alias("assisted"))
    old, new = c.filter("repo_id % 2 = 0"), c.filter("repo_id % 3 <> 0").select("repo_id", F.concat("name", F.lit("!")).alias("name"), F.lit(False).alias("assisted"))
    rows = snapshots.upsert(old, new, ["repo_id"], ("assisted",))
    projects = snapshots.upsert_projects(old.select(F.col("repo_id").cast("string").alias("root_path"), "name"), new.select(F.col("repo_id").cast("string").alias("root_path"), "name"))
    return rows.join(projects.select(F.col("root_path").cast("bigint").alias("repo_id"), F.col("name").alias("project"), "is_active"), "repo_id")


def target_order(spark, sf):
    """An answer for each target in order, or none."""
    targets = b.table(spark, sf, "nation").select(F.col("n_name").alias("target_id"), F.col("n_nationkey").alias("ord"))
    found = b.table(spark, sf, "customer").join(b.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).filter("c_custkey % 50 = 0").groupBy(F.col("n_name").alias("target_id")).agg(F.count("*").alias("scenarios"))
    return validate.in_target_order(targets, found)


def _undelivered_pointers(spark, sf):
    rows = transitions.latest(_requests(spark, sf))
    delivered = F.col("requested_at") % 4
    last = lambda c: F.when(delivered == 0, F.col(f"desired_{c}")).when(delivered == 1, F.concat(F.col(f"desired_{c}"), F.lit("-old"))).alias(f"last_delivered_{c}")
    rows = rows.withColumn("status", F.when(F.col("requested_at") % 5 == 0, "pending").otherwise("delivered"))
    return rows.select("*", *map(last, ("analysis_id", "head_sha", "state")))


def reconciler_round(spark, sf):
    """What a round queues: deliveries of what wasn't delivered, and stale branches, unless the ledger has them."""
    pointers = _undelivered_pointers(spark, sf)
    jobs = _jobs(spark, sf)
    ledger = lifecycle.undelivered(pointers).filter("repo_id % 2 = 0").select("idempotency_key")
    return lifecycle.round_of(jobs, pointers, stale_heads(spark, sf), ledger, _now())[1]


def terminal_pushes(spark, sf):
    """Running jobs that fail for good are reconciliations of their branch."""
    before = _jobs(spark, sf)
    kind = F.when(F.col("id") % 3 == 0, "permanent").otherwise("transient")
    after = transitions.retry(before, kind, _now()).select("*", F.col("user_id").alias("repo_id"), F.col("job_type").alias("branch"), F.col("lease_token").alias("_t"), F.col("id").cast("string").alias("sha"))
    return lifecycle.terminal_pushes(before, after, _now()).select("repo_id", "branch", "sha", "job_type", "payload_sha256")


def analysis_steps(spark, sf):
    """Orders as analyses: finished ones of which some lost their assessment; jobs for every order, and their outcomes."""
    o = b.table(spark, sf, "orders")
    own = [F.col("o_custkey").alias("repo_id"), (F.col("o_orderkey") % 7).cast("int").alias("pull_request_number"), F.col("o_orderkey").cast("string").alias("head_sha")]
    status_ = F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "P", "insufficient_evidence").otherwise("building")
    analyses = o.select(F.col("o_orderkey").alias("analysis_id"), *own, status_.alias("status"))
    planned = lifecycle.plan_analyses(o.select(F.col("o_orderkey").alias("job_id"), *own), analyses, analyses.filter("analysis_id % 3 <> 0"))
    results = o.select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderkey") % 5 == 0, "lost").alias("error"), (F.col("o_orderkey") % 2 == 0).alias("persisted"))
    return planned.select("job_id", "step").join(lifecycle.settle_analyses(planned, results), "job_id").select("job_id", "step", "analysis_status", "delivery_state", "retry")


def insert_ignored(spark, sf):
    """K5: of events that come again under their user and type, the first, unless the user is known."""
    e = b.table(spark, sf, "events").select(F.concat_ws(":", "user_id", "event_type").alias("key"), "event_id")
    known = e.filter("event_id % 7 = 0").select("key").distinct()
    return snapshots.insert_ignore(known, e, "key", "event_id")


def retry_transition(spark, sf):
    kind = F.when(F.col("value") % 3 < 1, "transient").when(F.col("value") % 3 < 2, "timeout").otherwise("permanent")
    return transitions.retry(_jobs(spark, sf), kind, _now()).select("id", "status", *_plain("available_at", "terminal_at"), "last_error_kind", "lease_token")


def lease_reap(spark, sf):
    return transitions.reap(_jobs(spark, sf), _now()).select("id", "status", "attempts", *_plain("available_at", "terminal_at"), "last_error_kind", "lease_token")


def job_claim(spark, sf):
    return transitions.claim(_jobs(spark, sf), _now(), F.lit("new")).select("id", "job_type", "status", "attempts", "lease_token", *_plain("lease_expires_at", "first_started_at"))


def access_state_fold(spark, sf):
    e = b.table(spark, sf, "events")
    named = F.element_at(F.create_map(*[F.lit(x) for pair in (("signup", "created"), ("view", "suspend"), ("purchase", "unsuspend"), ("error", "deleted"), ("click", "noop")) for x in pair]), F.col("event_type"))
    named = F.when(F.col("event_type") == "click", F.element_at(F.array(F.lit("added"), F.lit("removed"), F.lit("noop")), (F.col("event_id") % 3 + 1).cast("int"))).otherwise(named)
    return transitions.fold_access(e.select(F.col("user_id").alias("repo_id"), F.col("event_id").alias("ordinal"), named.alias("event")))


def error_class(spark, sf):
    e = b.table(spark, sf, "events")
    typed = F.when(F.col("event_id") % 17 == 0, "timeout").when(F.col("event_id") % 19 == 0, "cancelled")
    code = F.when(F.col("event_id") % 13 == 0, "ECONNRESET").otherwise("EOTHER")
    message = F.when(F.col("event_type") == "error", "Database is Unavailable").otherwise(F.col("event_type"))
    return e.select("event_id", classify.error_kind(typed, F.floor("value").cast("int"), code, message).alias("error_kind"), classify.deadline_seconds(F.element_at(F.array(*map(F.lit, JOB_TYPES)), (F.col("event_id") % len(JOB_TYPES) + 1).cast("int"))).alias("deadline"))


def gap_hunks(spark, sf):
    e = b.table(spark, sf, "events").select("user_id", F.col("event_id").alias("at"))
    return evidence.gap_groups(e, "user_id", "at", gap=100).groupBy("user_id", "hunk").agg(F.min("at").alias("start"), F.max("at").alias("end"), F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        queue_health, recent_status, stale_heads, latest_pointer, undelivered, stale_job_skip, idempotent_ingest, bucketed_dedupe,
        complete_jobs, superseded_pushes, fenced_outcomes, webhook_jobs, account_upsert, target_order, insert_ignored, reconciler_round, terminal_pushes, analysis_steps,
        retry_transition, lease_reap, job_claim, access_state_fold, error_class, gap_hunks,
    )
}

_JOBS = f"""jobs AS (
  SELECT event_id AS id, event_type AS job_type, ['pending', 'running', 'completed', 'running', 'failed'][(event_id % 5 + 1)::INT] AS status, (event_id % 4)::INT AS attempts,
         ts AS enqueued_at, CASE WHEN event_id % 5 <> 0 THEN ts + to_seconds(event_id % 90) END AS first_started_at, ts AS available_at, 't' || event_id AS lease_token,
         TIMESTAMP '{NOW}' + to_seconds(CASE WHEN event_id % 2 = 0 THEN event_id % 600 + 1 ELSE -(event_id % 600) - 1 END) AS lease_expires_at, value, TIMESTAMP '{NOW}' AS now FROM events)"""
_POINTERS = """requests AS (
  SELECT user_id AS repo_id, (event_id % 3)::INT AS pull_request_number, event_id AS requested_at, event_id::VARCHAR AS desired_analysis_id, event_type AS desired_state, printf('%.2f', value) AS desired_head_sha FROM events),
pointers AS (SELECT r.* FROM requests r JOIN (SELECT repo_id, pull_request_number, max(requested_at) AS requested_at FROM requests GROUP BY ALL) m USING (repo_id, pull_request_number, requested_at))"""
_BACK = "CASE WHEN {mine} THEN CASE WHEN {again} THEN 'pending' ELSE 'failed' END ELSE status END AS status, CASE WHEN {mine} AND {again} THEN now + to_seconds(CASE WHEN attempts <= 1 THEN 30 ELSE 120 END) ELSE available_at END AS available_at, CASE WHEN {mine} AND NOT {again} THEN now END AS terminal_at, CASE WHEN {mine} THEN {kind} END AS last_error_kind, CASE WHEN NOT {mine} THEN lease_token END AS lease_token"
ORACLES = {
    "queue_health": f"""WITH {_JOBS}
SELECT job_type, status, count(*) AS count, round(avg(epoch_us(first_started_at) - epoch_us(enqueued_at)) / 1e6, 1)::DOUBLE AS average_queue_latency_seconds,
       trunc(max((epoch_us(now) - epoch_us(enqueued_at)) / 1e6) FILTER (status = 'pending'))::INT AS oldest_pending_seconds FROM jobs GROUP BY ALL""",
    "recent_status": """
WITH a AS (SELECT o_orderkey AS analysis_id, o_custkey AS repo_id, (o_orderkey % 7)::INT AS pull_request_number, o_orderstatus AS analysis_status, o_orderdate AS created_at FROM orders),
r AS (SELECT l_orderkey AS analysis_id, max(l_linestatus) AS report_status FROM lineitem GROUP BY 1),
d AS (SELECT c_custkey AS repo_id, (c_custkey % 7)::INT AS pull_request_number, c_mktsegment AS delivery_status FROM customer)
SELECT a.*, report_status, delivery_status FROM a LEFT JOIN r USING (analysis_id) LEFT JOIN d USING (repo_id, pull_request_number) ORDER BY created_at DESC, analysis_id DESC LIMIT 20""",
    "stale_heads": """
WITH c AS (SELECT DISTINCT user_id AS repo_id, 'main' AS branch FROM events),
v AS (SELECT user_id AS repo_id, max(event_id)::VARCHAR AS current_sha FROM events WHERE event_type = 'view' GROUP BY 1),
l AS (SELECT user_id AS repo_id, max(event_id) AS live FROM events WHERE event_type = 'purchase' GROUP BY 1),
x AS (SELECT repo_id, branch, current_sha, CASE WHEN live % 11 <> 0 THEN live::VARCHAR END AS live_sha, CASE WHEN live % 11 = 0 THEN 'not found' END AS error FROM c LEFT JOIN v USING (repo_id) LEFT JOIN l USING (repo_id))
SELECT * FROM x WHERE error IS NOT NULL OR current_sha IS DISTINCT FROM live_sha""",
    "latest_pointer": f"WITH {_POINTERS} SELECT * FROM pointers",
    "undelivered": f"""WITH {_POINTERS} SELECT repo_id, pull_request_number, desired_analysis_id FROM pointers WHERE requested_at % 5 = 0 OR requested_at % 4 <> 0""",
    "stale_job_skip": f"""WITH {_POINTERS} SELECT r.requested_at AS job_id, r.requested_at <> p.requested_at AS skipped FROM requests r JOIN pointers p USING (repo_id, pull_request_number)""",
    "idempotent_ingest": """
WITH k AS (SELECT event_id, ts, sha256((event_id % 500)::VARCHAR || ':' || event_type || '::' || (user_id % 50)::VARCHAR || '::' || CASE WHEN event_id % 2 = 0 THEN (event_id % 10)::VARCHAR ELSE '' END) AS idempotency_key FROM events)
SELECT event_id, ts, idempotency_key FROM (SELECT *, row_number() OVER (PARTITION BY idempotency_key ORDER BY event_id) AS r FROM k)
WHERE r = 1 AND idempotency_key NOT IN (SELECT idempotency_key FROM k WHERE event_id % 10 = 0)""",
    "bucketed_dedupe": """
WITH e AS (SELECT user_id % 3 AS repo_id, 'main' AS branch, event_type AS sha, epoch_ms(ts) // 300000 AS w FROM events),
j AS (SELECT *, '{"repoId":' || repo_id || ',"branch":"main","sha":"' || sha || '","reason":"tracked"' AS t FROM e)
SELECT repo_id, branch, sha, 'branch.reconcile' AS job_type, sha256(t || ',"window":' || w || '}') AS idempotency_key, sha256(t || '}') AS payload_sha256, count(*) AS n FROM j GROUP BY ALL""",
    "complete_jobs": f"WITH {_JOBS} SELECT id, CASE WHEN status = 'running' AND id % 2 = 0 THEN 'completed' ELSE status END AS status, CASE WHEN status = 'running' AND id % 2 = 0 THEN now END AS terminal_at FROM jobs",
    "superseded_pushes": "SELECT user_id AS repo_id, event_id AS after_sha FROM (SELECT *, max(event_id) OVER (PARTITION BY user_id) AS last FROM events) WHERE event_id <> last",
    "fenced_outcomes": f"""WITH {_POINTERS}
SELECT repo_id, pull_request_number, desired_analysis_id, CASE WHEN requested_at % 2 = 1 THEN 'pending' WHEN requested_at % 3 = 0 THEN 'failed' ELSE 'delivered' END AS status,
       CASE WHEN requested_at % 2 = 0 AND requested_at % 3 <> 0 THEN desired_analysis_id END AS last_delivered_analysis_id, CASE WHEN requested_at % 2 = 0 AND requested_at % 3 <> 0 THEN desired_state END AS last_delivered_state
FROM pointers""",
    "webhook_jobs": """
WITH e AS (
  SELECT *, 'd' || event_id AS delivery_id, CASE WHEN event_id % 3 = 0 THEN 'dev' ELSE 'main' END AS branch, CASE WHEN event_id % 10 = 0 THEN repeat('0', 40) ELSE 's' || event_id END AS sha,
         CASE user_id % 4 WHEN 0 THEN CASE WHEN user_id % 8 < 4 THEN 'dev' ELSE 'main' END WHEN 1 THEN NULL ELSE 'main' END AS tracked FROM events),
j AS (
  SELECT *, event_type = 'view' AS push FROM e
  WHERE branch = tracked AND ((event_type = 'view' AND event_id % 10 <> 0) OR (event_type = 'click' AND event_id % 5 <> 0)))
SELECT delivery_id, user_id AS repo_id, CASE WHEN NOT push THEN (event_id % 100)::INT END AS pull_request_number, sha, CASE WHEN push THEN 'branch.push' ELSE 'pull_request.analyze' END AS job_type,
       sha256(delivery_id || ':' || CASE WHEN push THEN 'push:' ELSE 'pull_request:opened' END || ':' || user_id || ':' || sha || ':' || CASE WHEN push THEN '' ELSE (event_id % 100)::VARCHAR END) AS idempotency_key FROM j""",
    "account_upsert": """
SELECT c_custkey AS repo_id, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment || '!' ELSE c_mktsegment END AS name, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 5 = 0 ELSE false END AS assisted,
       CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment || '!' ELSE c_mktsegment END AS project, c_custkey % 3 <> 0 AS is_active FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 <> 0""",
    "target_order": """
SELECT n_name AS target_id, n_nationkey AS ord, s.scenarios FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS scenarios FROM customer WHERE c_custkey % 50 = 0 GROUP BY 1) s ON c_nationkey = n_nationkey""",
    "reconciler_round": f"""WITH {_POINTERS},
d AS (
  SELECT 'pull_request.deliver' AS job_type, repo_id,
         sha256('{{"repoId":' || repo_id || ',"number":' || pull_request_number || ',"analysisId":"' || desired_analysis_id || '","headSha":"' || desired_head_sha || '","state":"' || desired_state || '"}}') AS idempotency_key
  FROM pointers WHERE (requested_at % 5 = 0 OR requested_at % 4 <> 0) AND repo_id % 2 = 1),
c AS (SELECT DISTINCT user_id AS repo_id FROM events),
v AS (SELECT user_id AS repo_id, max(event_id)::VARCHAR AS current_sha FROM events WHERE event_type = 'view' GROUP BY 1),
l AS (SELECT user_id AS repo_id, max(event_id) AS live FROM events WHERE event_type = 'purchase' GROUP BY 1),
s AS (SELECT repo_id, current_sha, live::VARCHAR AS sha FROM c JOIN l USING (repo_id) LEFT JOIN v USING (repo_id) WHERE live % 11 <> 0 AND current_sha IS DISTINCT FROM live::VARCHAR)
SELECT job_type, idempotency_key, repo_id FROM d
UNION ALL SELECT 'branch.reconcile', sha256('{{"repoId":' || repo_id || ',"branch":"main","sha":"' || sha || '","reason":"' || CASE WHEN current_sha IS NULL THEN 'no graph of the branch yet' ELSE 'the branch''s graph is of an older commit' END
  || '","window":' || (epoch_ms(TIMESTAMP '{NOW}') // 300000) || '}}'), repo_id FROM s""",
    "terminal_pushes": f"""WITH {_JOBS},
k AS (SELECT j.*, e.user_id, CASE WHEN j.id % 3 = 0 THEN 'permanent' ELSE 'transient' END AS kind FROM jobs j JOIN events e ON e.event_id = j.id)
SELECT user_id AS repo_id, job_type AS branch, id::VARCHAR AS sha, 'branch.reconcile' AS job_type,
       sha256('{{"repoId":' || user_id || ',"branch":"' || job_type || '","sha":"' || id || '","reason":"terminal branch.push failure: ' || kind || '"}}') AS payload_sha256
FROM k WHERE status = 'running' AND (kind = 'permanent' OR attempts >= 3)""",
    "analysis_steps": """
WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus NOT IN ('F', 'P') THEN 'build' WHEN o_orderkey % 3 <> 0 THEN 'reuse' ELSE 'repair' END AS step FROM orders),
s AS (SELECT *, CASE WHEN k % 5 <> 0 THEN 'ready' WHEN k % 2 <> 0 AND step = 'build' THEN 'failed' END AS state FROM o)
SELECT k AS job_id, step, state AS analysis_status, state AS delivery_state, k % 5 = 0 AS retry FROM s""",
    "insert_ignored": """
WITH e AS (SELECT user_id || ':' || event_type AS key, event_id FROM events)
SELECT key, min(event_id) AS event_id FROM e WHERE key NOT IN (SELECT key FROM e WHERE event_id % 7 = 0) GROUP BY key""",
    "retry_transition": f"WITH {_JOBS}, k AS (SELECT *, CASE WHEN value % 3 < 1 THEN 'transient' WHEN value % 3 < 2 THEN 'timeout' ELSE 'permanent' END AS kind FROM jobs) SELECT id, "
    + _BACK.format(mine="status = 'running'", again="(kind <> 'permanent' AND attempts < 3)", kind="kind")
    + " FROM k",
    "lease_reap": f"WITH {_JOBS} SELECT id, attempts, " + _BACK.format(mine="(status = 'running' AND lease_expires_at < now)", again="attempts < 3", kind="'worker_lost'") + " FROM jobs",
    "job_claim": f"""WITH {_JOBS}, f AS (SELECT min(id) AS id FROM jobs WHERE status = 'pending' AND available_at <= now GROUP BY job_type)
SELECT id, job_type, CASE WHEN id IN (FROM f) THEN 'running' ELSE status END AS status, (attempts + (id IN (FROM f))::INT)::INT AS attempts, CASE WHEN id IN (FROM f) THEN 'new' ELSE lease_token END AS lease_token,
       CASE WHEN id IN (FROM f) THEN now + to_seconds(600) ELSE lease_expires_at END AS lease_expires_at, CASE WHEN id IN (FROM f) THEN coalesce(first_started_at, now) ELSE first_started_at END AS first_started_at FROM jobs""",
    "access_state_fold": """
WITH RECURSIVE e AS (SELECT user_id AS repo_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
f AS (
  SELECT repo_id, 0::BIGINT AS i, 'none' AS s, n FROM e WHERE i = 1
  UNION ALL
  SELECT f.repo_id, e.i, CASE e.event_type WHEN 'signup' THEN 'active' WHEN 'error' THEN 'deleted' WHEN 'click' THEN CASE e.event_id % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'removed' ELSE f.s END WHEN 'view' THEN CASE WHEN f.s = 'active' THEN 'suspended' ELSE f.s END
    WHEN 'purchase' THEN CASE WHEN f.s = 'suspended' THEN 'active' ELSE f.s END ELSE f.s END, f.n
  FROM f JOIN e ON e.repo_id = f.repo_id AND e.i = f.i + 1)
SELECT repo_id, s AS access_state, n AS n_events FROM f WHERE i = n""",
    "error_class": """
SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'timeout' WHEN event_id % 19 = 0 THEN 'cancelled' WHEN floor(value) = 429 OR floor(value) >= 500 THEN 'transient'
  WHEN event_id % 13 = 0 THEN 'transient' WHEN event_type = 'error' THEN 'transient' ELSE 'permanent' END AS error_kind, [480, 480, 300, 300, 30, 30][event_id % 6 + 1]::INT AS deadline FROM events""",
    "gap_hunks": """
WITH g AS (SELECT user_id, event_id, (event_id - lag(event_id) OVER w > 100)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
h AS (SELECT user_id, event_id, sum(coalesce(new, 0)) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS hunk FROM g)
SELECT user_id, hunk, min(event_id) AS start, max(event_id) AS "end", count(*) AS n FROM h GROUP BY ALL""",
}
