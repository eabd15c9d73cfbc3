"""Packets of evidence for guidance, and the analyzer that is injected to read them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import evidence

#: One answer of an analyzer: a scenario of a target.
SCENARIO = "target_id string, ord int, title string, setup string, actions array<string>, expected array<string>, hunk_ids array<string>, anchor_ids array<string>"


class Analyzer(Protocol):
    """Reads one packet (target, kind, and its anchors as dictionaries) and answers with scenarios, each a dictionary of SCENARIO without target_id."""

    def analyze(self, target: str, kind: str, anchors: list[dict]) -> list[dict]: ...


def packets(targets: DataFrame, anchors: DataFrame) -> DataFrame:
    """target_id, kind and its anchors with ids, in order, cut to what a packet holds; targets without grounding are left out.

    targets: target_id, ord, kind. anchors: target_id, source, seq, kind, path,
    start_line, end_line, excerpt; source is 0 for changed declarations, 1 for
    the route's own file, 2 for the changed file, 3 for uses along the path and
    4 for tests. Anchors are bounded before a target's are gathered.
    """
    few = evidence.nominees(anchors.select("target_id", "kind", "path", "start_line", "end_line", text.excerpt(F.col("excerpt")).alias("excerpt")), "target_id")
    place = anchors.groupBy("target_id", "kind", "path", "start_line", "end_line").agg(F.min(F.struct("source", "seq")).alias("place"))
    ordered = F.array_sort(F.collect_list(F.struct("place", F.struct("kind", "path", "start_line", "end_line", "excerpt").alias("a"))))
    grouped = few.join(place, ["target_id", "kind", "path", "start_line", "end_line"]).groupBy("target_id").agg(F.transform(ordered, lambda s: s["a"]).alias("anchors"))
    kept = targets.join(grouped, "target_id").withColumn("anchors", evidence.trim(evidence.in_priority(F.col("anchors"))))
    kept = kept.filter(evidence.grounded(F.col("kind"), F.col("anchors")))
    named = F.transform("anchors", lambda a, i: F.struct(F.format_string("anchor:%d:%d", F.col("ord"), i + 1).alias("id"), a["kind"].alias("kind"), a["path"].alias("path"), a["start_line"].alias("start_line"), a["end_line"].alias("end_line"), a["excerpt"].alias("excerpt")))
    return kept.select("target_id", "ord", "kind", named.alias("anchors"))


def analyze(found: DataFrame, make: Callable[[], Analyzer] | None) -> DataFrame:
    """The answers of an injected analyzer, made once for each task, to each packet; none without one."""
    if make is None:
        return found.sparkSession.createDataFrame([], SCENARIO)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        analyzer, names = make(), [f.split()[0] for f in SCENARIO.split(", ")]
        for frame in frames:
            rows = []
            for target, kind, anchors in zip(frame["target_id"], frame["kind"], frame["anchors"], strict=True):
                said = analyzer.analyze(target, kind, [a.asDict() if hasattr(a, "asDict") else dict(a) for a in anchors])
                rows += [[target, i, *[s.get(n) for n in names[2:]]] for i, s in enumerate(said)]
            yield pd.DataFrame(rows, columns=names)

    return found.select("target_id", "kind", "anchors").mapInPandas(run, SCENARIO)
