"""State transitions of jobs, pointers and access as column expressions and folds.

``now`` is always a column or literal given by the caller: nothing here reads
a clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify

POINTER = ("repo_id", "pull_request_number")
FENCE = ("desired_analysis_id", "desired_head_sha", "desired_state")


def seconds_later(moment: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(moment.cast("timestamp")) + seconds.cast("long") * 1_000_000)


def retry(jobs: DataFrame, kind: Column, now: Column, token: Column | None = None) -> DataFrame:
    """T5: a failed run goes back to pending with backoff if its error may pass and attempts are left, else it has failed.

    Only running jobs whose lease is still the caller's change.
    """
    mine = F.col("status") == "running"
    if token is not None:
        mine = mine & (F.col("lease_token") == token)
    again = kind.isin("transient", "timeout") & (F.col("attempts") < classify.MAX_ATTEMPTS)
    return _back(jobs, mine, again, kind, now)


def reap(jobs: DataFrame, now: Column) -> DataFrame:
    """Running jobs whose lease is over are pending again, or failed after the last attempt."""
    over = (F.col("status") == "running") & (F.col("lease_expires_at") < now)
    return _back(jobs, over, F.col("attempts") < classify.MAX_ATTEMPTS, F.lit("worker_lost"), now)


def _back(jobs: DataFrame, mine: Column, again: Column, kind: Column, now: Column) -> DataFrame:
    mine = F.coalesce(mine, F.lit(False))
    set_ = lambda name, value: F.when(mine, value).otherwise(F.col(name)).alias(name)
    changed = {
        "status": F.when(again, "pending").otherwise("failed"),
        "available_at": F.when(again, seconds_later(now, classify.backoff_seconds(F.col("attempts")))).otherwise(F.col("available_at")),
        "terminal_at": F.when(~again, now),
        "last_error_kind": kind,
        "lease_token": F.lit(None).cast("string"),
        "lease_expires_at": F.lit(None).cast("timestamp"),
    }
    return jobs.select(*[set_(c, changed[c]) if c in changed else F.col(c) for c in jobs.columns])


def claim(jobs: DataFrame, now: Column, token: Column) -> DataFrame:
    """Of each job type, the pending job with the lowest id that is due is running, with a new lease."""
    due = (F.col("status") == "pending") & (F.col("available_at") <= now)
    first = jobs.filter(due).groupBy("job_type").agg(F.min("id").alias("first"))
    rows = jobs.join(first, "job_type", "left")
    mine = F.coalesce(F.col("id") == F.col("first"), F.lit(False))
    changed = {
        "status": F.lit("running"),
        "attempts": F.col("attempts") + 1,
        "lease_token": token,
        "lease_expires_at": seconds_later(now, F.lit(classify.LEASE)),
        "first_started_at": F.coalesce("first_started_at", now),
        "last_error_kind": F.lit(None).cast("string"),
    }
    return rows.select(*[F.when(mine, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in jobs.columns])


def complete(jobs: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """T4: running jobs whose lease token is the given one are completed; a token that doesn't match is an error.

    done: id, token.
    """
    rows = jobs.join(done.select("id", F.col("token").alias("given")), "id", "left")
    fine = (F.col("status") == "running") & F.col("lease_token").eqNullSafe(F.col("given"))
    status = F.when(F.col("given").isNull(), F.col("status")).when(fine, "completed").otherwise(F.raise_error(F.concat(F.lit("lost the lease of job "), F.col("id").cast("string"))).cast("string"))
    return rows.select(*[status.alias(c) if c == "status" else F.when(F.col("given").isNotNull(), now).otherwise(F.col(c)).alias(c) if c == "terminal_at" else F.col(c) for c in jobs.columns])


def latest(requests: DataFrame, order: str = "requested_at") -> DataFrame:
    """The last request of each pointer."""
    rest = [c for c in requests.columns if c not in POINTER]
    return requests.groupBy(*POINTER).agg(F.max_by(F.struct(*rest), F.struct(order)).alias("r")).select(*POINTER, "r.*")


def undelivered(pointers: DataFrame) -> DataFrame:
    """Pointers with something desired that wasn't delivered last."""
    waiting = (F.col("status") != "delivered") | F.col("last_delivered_analysis_id").isNull()
    for column in ("analysis_id", "head_sha", "state"):
        waiting = waiting | (F.col(f"desired_{column}") != F.col(f"last_delivered_{column}"))
    return pointers.filter(F.col("desired_analysis_id").isNotNull() & F.coalesce(waiting, F.lit(False)))


def fenced(pointers: DataFrame, outcomes: DataFrame) -> DataFrame:
    """K7: an outcome (pointer, desired fields, status) applies only while the pointer still desires it."""
    key = [*POINTER, *FENCE]
    matched = pointers.join(outcomes.select(*key, F.col("status").alias("outcome")), key, "left")
    hit, told = F.col("outcome").isNotNull(), F.col("outcome") == "delivered"
    changed = {"status": F.when(hit, F.col("outcome")).otherwise(F.col("status"))}
    changed |= {f"last_delivered_{c}": F.when(told, F.col(f"desired_{c}")).otherwise(F.col(f"last_delivered_{c}")) for c in ("analysis_id", "head_sha", "state")}
    return matched.select(*[F.coalesce(changed[c], F.col(c)).alias(c) if c in changed else F.col(c) for c in pointers.columns])


def stale(jobs: DataFrame, pointers: DataFrame) -> DataFrame:
    """Jobs whose pointer no longer desires what they deliver; (job_id, skipped)."""
    rows = jobs.join(pointers.select(*POINTER, *FENCE), list(POINTER), "left")
    same = F.lit(True)
    for column in ("analysis_id", "head_sha", "state"):
        same = same & F.col(column).eqNullSafe(F.col(f"desired_{column}"))
    return rows.select("job_id", (~same).alias("skipped"))


def superseded(pushes: DataFrame, heads: DataFrame) -> DataFrame:
    """Pushes whose commit is no longer the branch's head."""
    return pushes.join(heads.select("repo_id", "branch", "live_sha"), ["repo_id", "branch"], "left").filter(~F.col("after_sha").eqNullSafe(F.col("live_sha")))


#: Access after an event: {event: {state before: state after}}; ``*`` is any, absent events change nothing.
ACCESS = {
    "created": {"*": "active"},
    "added": {"*": "active"},
    "suspend": {"active": "suspended"},
    "unsuspend": {"suspended": "active"},
    "removed": {"*": "removed"},
    "deleted": {"*": "deleted"},
}
#: Events after which a repository's graph is built.
SYNCED = ("created", "added", "unsuspend", "new_permissions_accepted")


def next_access(state: Column, event: Column) -> Column:
    """The state after one event."""
    out = F
    for name, moves in ACCESS.items():
        for before, after in moves.items():
            out = out.when((event == name) if before == "*" else (event == name) & (state == before), after)
    return out.otherwise(state)


def fold_access(events: DataFrame, start: str = "none") -> DataFrame:
    """(repo_id, access_state, n_events) after all of a repository's events in order of ``ordinal``.

    An ordered fold: the guards make it depend on what came before, so it isn't
    a maximum. A repository's events are gathered in one array.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "event"))), lambda s: s["event"])
    grouped = events.groupBy("repo_id").agg(ordered.alias("events"))
    return grouped.select("repo_id", F.aggregate("events", F.lit(start), next_access).alias("access_state"), F.size("events").cast("bigint").alias("n_events"))
