"""Operational status: queue health, recent work, stale branches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def queue_health(jobs: DataFrame, now: Column) -> DataFrame:
    """A1: jobs by type and status, with the average latency to the first start and the oldest pending age in seconds."""
    seconds = lambda a, b: (F.unix_micros(b) - F.unix_micros(a)) / 1e6
    started = F.when(F.col("first_started_at").isNotNull(), seconds(F.col("enqueued_at"), F.col("first_started_at")))
    waiting = F.when(F.col("status") == "pending", seconds(F.col("enqueued_at"), now))
    return jobs.groupBy("job_type", "status").agg(F.count("*").alias("count"), F.round(F.avg(started), 1).alias("average_queue_latency_seconds"), F.max(waiting).cast("int").alias("oldest_pending_seconds")).orderBy("job_type", "status")


def recent(analyses: DataFrame, reports: DataFrame, deliveries: DataFrame, most: int = 20) -> DataFrame:
    """The latest analyses with their report and delivery.

    The few latest are taken before the joins, so only they meet the others.
    """
    top = analyses.orderBy(F.desc("created_at"), F.desc("analysis_id")).limit(most)
    return top.join(reports, "analysis_id", "left").join(deliveries, ["repo_id", "pull_request_number"], "left")


def stale_branches(configs: DataFrame, current: DataFrame, live: DataFrame) -> DataFrame:
    """Tracked branches whose current graph isn't of the live commit; lookups that failed are rows with their error.

    configs: repo_id, branch; current: repo_id, branch, current_sha; live: repo_id, branch, live_sha, error.
    """
    rows = configs.join(current, ["repo_id", "branch"], "left").join(live, ["repo_id", "branch"], "left")
    return rows.filter(F.col("error").isNotNull() | ~F.col("current_sha").eqNullSafe(F.col("live_sha"))).select("repo_id", "branch", "current_sha", "live_sha", "error")


def current_graphs(snapshots: DataFrame) -> DataFrame:
    """Current snapshots, the latest first."""
    return snapshots.filter("is_current").orderBy(F.desc("completed_at"))


def active_projects(projects: DataFrame) -> DataFrame:
    """Active projects by repository and root."""
    return projects.filter("is_active").orderBy("repo_id", "root_path")


def document(**sections: DataFrame) -> DataFrame:
    """The sections' rows as one JSON document, one row."""
    out = None
    for name, rows in sections.items():
        own = rows.agg(F.collect_list(F.struct(*rows.columns)).alias(name))
        out = own if out is None else out.crossJoin(F.broadcast(own))
    return out.select(F.to_json(F.struct(*sections)).alias("document"))
