"""The comment sink (K8, D3): bodies go to an injected writer, once for each pointer of a batch."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


class CommentWriter(Protocol):
    def update(self, repo_id: int, comment_id: int, body: str) -> bool: ...

    def find(self, repo_id: int, number: int, marker: str) -> int | None: ...

    def create(self, repo_id: int, number: int, body: str) -> int: ...


def bodies(pointers: DataFrame, analyses: DataFrame) -> DataFrame:
    """What each pointer's comment says: repo_id, pull_request_number, comment_id, marker, body."""
    rows = pointers.join(analyses, "analysis_id")
    mark = text.marker(F.col("repo_id"), F.col("pull_request_number"))
    body = text.comment_body(F.col("analysis_status"), F.col("base_sha"), F.col("head_sha"), mark, F.col("markdown"))
    return rows.select("repo_id", "pull_request_number", "comment_id", mark.alias("marker"), body.alias("body"))


def deliver(writer: CommentWriter, repo_id: int, number: int, comment_id: int | None, marker: str, body: str) -> int:
    """Update the known comment; if it is gone, the one with the marker; else create one. Its id."""
    if comment_id is not None and writer.update(repo_id, comment_id, body):
        return comment_id
    found = writer.find(repo_id, number, marker)
    if found is not None and writer.update(repo_id, found, body):
        return found
    return writer.create(repo_id, number, body)


def sink(make_writer: Callable[[], CommentWriter]):
    """A function for foreachBatch: each partition delivers its own rows through a writer of its own."""

    def batch(rows: DataFrame, _: int) -> None:
        def part(it):
            writer = make_writer()
            for r in it:
                deliver(writer, r.repo_id, r.pull_request_number, r.comment_id, r.marker, r.body)

        rows.foreachPartition(part)

    return batch
