"""Set-based steps of analyses and reconciliations: what a batch of claimed jobs does next, and what is queued after it.

Every step is a function of tables, so a batch that is run again gives the same
rows, and keys of queued jobs make repeated scans harmless.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from . import ingest, transitions

#: What an analysis is known by.
ANALYSIS = ("repo_id", "pull_request_number", "head_sha")


def plan_analyses(jobs: DataFrame, analyses: DataFrame, assessments: DataFrame) -> DataFrame:
    """The claimed jobs with analysis_id and ``step``: reuse a finished analysis, repair one that lost its assessment, or build.

    jobs: job_id and ANALYSIS; analyses: analysis_id, ANALYSIS, status;
    assessments: analysis_id. Only finished analyses are reused; of several the
    last counts.
    """
    done = analyses.filter(F.col("status").isin("ready", "insufficient_evidence")).groupBy(*ANALYSIS).agg(F.max("analysis_id").alias("analysis_id"))
    judged = assessments.select("analysis_id").distinct().withColumn("judged", F.lit(True))
    rows = jobs.join(done, list(ANALYSIS), "left").join(judged, "analysis_id", "left")
    step = F.when(F.col("analysis_id").isNull(), "build").when(F.col("judged"), "reuse").otherwise("repair")
    return rows.select(*jobs.columns, "analysis_id", step.alias("step"))


def settle_analyses(planned: DataFrame, results: DataFrame) -> DataFrame:
    """After the work: (job_id, ANALYSIS, analysis_status, delivery_state, retry).

    results: job_id, error (null if it went well), persisted (the analysis is
    stored). A stored analysis is never rewritten as failed, whatever fails
    later; its job is only tried again. What had no result is left running.
    """
    rows = planned.join(results, "job_id")
    failed, stored = F.col("error").isNotNull(), F.coalesce("persisted", F.lit(False)) | (F.col("step") != "build")
    state = F.when(~failed, "ready").when(~stored, "failed")
    return rows.select("job_id", *ANALYSIS, state.alias("analysis_status"), state.alias("delivery_state"), failed.alias("retry"))


def terminal_pushes(before: DataFrame, after: DataFrame, now: Column) -> DataFrame:
    """Pushes that failed for good in this batch, as reconciliations of their branch.

    before, after: jobs with id, status, last_error_kind; after also repo_id, branch, sha.
    """
    lost = after.filter("status = 'failed'").join(before.filter("status = 'failed'").select("id"), "id", "left_anti")
    return ingest.reconcile(lost, now, F.concat(F.lit("terminal branch.push failure: "), F.coalesce("last_error_kind", F.lit("unknown"))))


def stale_branches(found: DataFrame, now: Column) -> DataFrame:
    """The rows of status.stale_branches whose live commit is known, as reconciliations."""
    reason = F.when(F.col("current_sha").isNull(), "no graph of the branch yet").otherwise("the branch's graph is of an older commit")
    return ingest.reconcile(found.filter("error is null and live_sha is not null").withColumn("sha", F.col("live_sha")), now, reason)


def undelivered(pointers: DataFrame) -> DataFrame:
    """A delivery job for each pointer with something desired that wasn't delivered last; one key for each such state."""
    rows = transitions.undelivered(pointers)
    payload = [F.col("repo_id").alias("repoId"), F.col("pull_request_number").alias("number"), F.col("desired_analysis_id").alias("analysisId"), F.col("desired_head_sha").alias("headSha"), F.col("desired_state").alias("state")]
    return rows.select("repo_id", "pull_request_number", F.lit("pull_request.deliver").alias("job_type"), keys.json_digest(*payload).alias("idempotency_key"))


def round_of(jobs: DataFrame, pointers: DataFrame, found: DataFrame, ledger: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """One round of the reconciler: the jobs after the reaper, and what is queued anew (job_type, idempotency_key, repo_id)."""
    queued = stale_branches(found, now).select("job_type", "idempotency_key", "repo_id").unionByName(undelivered(pointers).select("job_type", "idempotency_key", "repo_id"))
    return transitions.reap(jobs, now), ingest.once(queued, ledger, "repo_id")


def log_lines(rows: DataFrame, level: str, message: str, now: Column, least: str = "info") -> DataFrame:
    """K9: a JSON line for each row, with its columns as fields; none below the least level."""
    levels = ("debug", "info", "warn", "error")
    fields = [F.lit(level).alias("level"), F.lit(message).alias("message"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("time"), *[F.col(c) for c in rows.columns]]
    return rows.filter(F.lit(levels.index(level) >= levels.index(least))).select(F.to_json(F.struct(*fields)).alias("line"))
