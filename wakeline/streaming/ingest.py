"""Idempotent ingest of event deliveries, batch and streaming."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import keys, paths

#: Pull-request actions that start an analysis.
ANALYZED_ACTIONS = ("opened", "synchronize", "reopened")
#: The state store that keeps keys on disk.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def once(batch: DataFrame, ledger: DataFrame, ordinal: str, key: str = "idempotency_key") -> DataFrame:
    """The first row of each key of the batch that the ledger doesn't have.

    Keys are never forgotten, as a watermark would; the ledger is met by an anti-join.
    """
    rest = [c for c in batch.columns if c != key]
    fresh = batch.join(ledger.select(key).distinct(), key, "left_anti")
    return fresh.groupBy(key).agg(F.min_by(F.struct(*rest), ordinal).alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in rest], key)


def signed(deliveries: DataFrame, secret: str) -> DataFrame:
    """Adds ``response``: 400 without the event headers, 401 for a wrong signature, else 202.

    deliveries: delivery_id, event_name, signature, body.
    """
    at = [deliveries.columns.index(c) for c in ("delivery_id", "event_name", "signature", "body")]

    def run(batches):
        for batch in batches:
            codes = []
            for delivery, event, signature, body in zip(*(batch.column(i).to_pylist() for i in at), strict=True):
                good = "sha256=" + hmac.new(secret.encode(), (body or "").encode(), hashlib.sha256).hexdigest()
                codes.append(400 if not delivery or not event or not signature else 202 if hmac.compare_digest(good, signature) else 401)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.int32())], [*batch.schema.names, "response"])

    from pyspark.sql.types import IntegerType, StructField, StructType

    return deliveries.mapInArrow(run, StructType([*deliveries.schema.fields, StructField("response", IntegerType())]))


def route(deliveries: DataFrame, configs: DataFrame) -> DataFrame:
    """Jobs of the accepted deliveries: pushes to a tracked branch, and pull requests against one.

    deliveries: delivery_id, event_name, body (JSON text). configs: repo_id,
    tracked_branch, is_active; a repository without one uses its default
    branch, an inactive one is dropped.
    """
    body = F.try_parse_json("body")
    text = lambda p: F.try_variant_get(body, p, "string")
    rows = deliveries.select(
        "delivery_id", "event_name", text("$.action").alias("event_action"), F.try_variant_get(body, "$.repository.id", "bigint").alias("repo_id"),
        text("$.repository.default_branch").alias("default_branch"), paths.branch_of(text("$.ref")).alias("pushed"), text("$.after").alias("after_sha"),
        text("$.pull_request.base.ref").alias("base_ref"), text("$.pull_request.head.sha").alias("head_sha"), F.try_variant_get(body, "$.pull_request.number", "int").alias("pull_request_number"),
        F.sha2("body", 256).alias("payload_sha256"),
    )
    rows = rows.join(configs, "repo_id", "left").filter(F.coalesce("is_active", F.lit(True)))
    tracked = F.coalesce("tracked_branch", "default_branch")
    push = (F.col("event_name") == "push") & (F.col("pushed") == tracked) & ~paths.is_zero_sha(F.col("after_sha"))
    pull = (F.col("event_name") == "pull_request") & F.col("event_action").isin(*ANALYZED_ACTIONS) & (F.col("base_ref") == tracked)
    rows = rows.withColumn("job_type", F.when(push, "branch.push").when(pull, "pull_request.analyze")).filter("job_type is not null")
    sha = F.coalesce("head_sha", "after_sha")
    key = keys.idempotency_key(F.col("delivery_id"), F.col("event_name"), F.col("event_action"), F.col("repo_id"), sha, F.col("pull_request_number"))
    return rows.select("delivery_id", "event_name", "event_action", "repo_id", "pull_request_number", sha.alias("sha"), "job_type", "payload_sha256", key.alias("idempotency_key"))


def reconcile(branches: DataFrame, now, reason: str | Column) -> DataFrame:
    """One reconciliation per payload and five-minute bucket, by the digest of both; an unknown part has no digest."""
    payload = [F.col("repo_id").alias("repoId"), F.col("branch"), F.col("sha"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason")]
    window = keys.bucket(now)
    known = lambda digest, *more: F.when(reduce(Column.__and__, [c.isNotNull() for c in (*payload, *more)]), digest)
    digest, told = keys.json_digest(*payload, window.alias("window")), keys.json_digest(*payload)
    return branches.select("repo_id", "branch", "sha", F.lit("branch.reconcile").alias("job_type"), known(digest, window).alias("idempotency_key"), known(told).alias("payload_sha256"))


class First(StatefulProcessor):
    """Lets the first row of a key through, once and for all: a key's state is a mark that it was seen."""

    def __init__(self, ordinal: str):
        self.ordinal = ordinal

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first = min(rows, key=lambda r: r[self.ordinal])
        if not self.seen.exists():
            self.seen.update((True,))
            yield first

    def close(self) -> None:
        pass


def once_streamed(rows: DataFrame, ordinal: str, key: str = "idempotency_key") -> DataFrame:
    """T1, T2 as a stream: the first row of each key, by ``ordinal`` within its batch.

    Keys live in the state store, never forgotten: a batch looks up its own keys
    only, however many went before. The store is RocksDB, which keeps them on
    disk and writes what changed.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return rows.groupBy(key).transformWithState(First(ordinal), rows.schema, "append", "none")


def start(deliveries: DataFrame, configs: DataFrame, ledger: str, checkpoint: str, **trigger):
    """T1 as a stream: deliveries are routed, and each key's first job is appended to the ledger's folder once, whatever restarts."""
    jobs = once_streamed(route(deliveries, configs), "delivery_id")
    return jobs.writeStream.format("parquet").option("path", ledger).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
