"""Integrity of external wording: citations, sanitizing, first targets only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from .evidence import BEHAVIOR

#: Actions and outcomes of a scenario, and anchors it may cite.
STEPS, CITED = 3, 8


def integral(rows: DataFrame, key: str, ids: str, known: DataFrame) -> DataFrame:
    """Rows all of whose ids are known (``id``); a row without ids passes."""
    bad = rows.select(key, F.explode(ids).alias("id")).join(known.select("id"), "id", "left_anti").select(key).distinct()
    return rows.join(bad, key, "left_anti")


def in_target_order(targets: DataFrame, found: DataFrame) -> DataFrame:
    """An answer for each target in order; a target without one has no scenarios. found: target_id, scenarios."""
    return targets.select("target_id", "ord").join(found, "target_id", "left").orderBy("ord")


def sanitize_scenario(title: Column, setup: Column, actions: Column, expected: Column) -> Column:
    """The scenario's texts without implementation words, null if any part is lost."""
    name = text.strip_target(text.sanitize(title))
    where, steps, ends = text.sanitize(setup), F.transform(actions, text.sanitize), F.transform(expected, text.sanitize)
    lost = lambda xs: (F.size(xs) == 0) | F.exists(xs, lambda x: x.isNull())
    fine = lambda s: s["title"].isNotNull() & (setup.isNull() | s["setup"].isNotNull()) & ~lost(s["actions"]) & ~lost(s["expected"])
    return text.once(F.struct(name.alias("title"), where.alias("setup"), steps.alias("actions"), ends.alias("expected")), lambda s: F.when(fine(s), s))


def cite(anchor_ids: Column, anchors: Column) -> Column:
    """The cited ids with the target's entrypoint anchor first and a behaviour anchor next to it, at most CITED."""
    ids = F.array_distinct(anchor_ids)
    first = lambda *kinds: F.try_element_at(F.transform(F.filter(anchors, lambda a: a["kind"].isin(*kinds)), lambda a: a["id"]), F.lit(1))
    start, behavior = first("entrypoint"), first(*BEHAVIOR)
    put = lambda x, xs: F.when(x.isNull() | F.array_contains(xs, F.coalesce(x, F.lit(""))), xs).otherwise(F.concat(F.array(x), xs))
    added = put(start, ids)
    at = F.when(start.isNotNull(), 1).otherwise(0)
    with_behavior = F.concat(F.slice(added, 1, at), F.array(behavior), F.slice(added, at + 1, F.size(added) + 1))
    return F.slice(F.when(behavior.isNull() | F.array_contains(added, F.coalesce(behavior, F.lit(""))), added).otherwise(with_behavior), 1, CITED)


def validate(scenarios: DataFrame, targets: DataFrame, hunks: DataFrame) -> DataFrame:
    """The scenarios that stand: target_id, ord, title, setup, actions, expected, hunk_ids, anchor_ids.

    scenarios: answer_ord, target_id, ord, title, setup, actions, expected,
    hunk_ids, anchor_ids. targets: target_id, kind, path, changed_seed_path,
    dependency_path, api_verification_allowed, anchors. hunks: id, path.
    Only a target's first answer counts; a repeated title counts once, and is
    used up only by a scenario that stands.
    """
    own = W.partitionBy("target_id")
    rows = scenarios.withColumn("_first", F.min("answer_ord").over(own)).filter("answer_ord = _first").drop("_first")
    rows = rows.withColumn("actions", F.slice("actions", 1, STEPS)).withColumn("expected", F.slice("expected", 1, STEPS)).withColumn("_id", F.concat_ws(":", "target_id", F.col("ord").cast("string")))
    rows = rows.join(targets, "target_id").filter("kind <> 'api_route' or api_verification_allowed")
    # all cited hunks are known (J15), and one lies on the target's path: both from one pass over what is cited
    allowed = F.concat(F.array("path", "changed_seed_path"), "dependency_path")
    cited = rows.select("_id", allowed.alias("allowed"), F.explode(F.array_distinct("hunk_ids")).alias("id")).join(hunks.select("id", F.col("path").alias("hunk_path"), F.lit(True).alias("known")), "id", "left")
    told = cited.groupBy("_id").agg(F.bool_and(F.col("known").isNotNull()).alias("known"), F.bool_or(F.array_contains("allowed", F.col("hunk_path"))).alias("fits"))
    rows = rows.join(told.filter("known and fits").select("_id"), "_id", "left_semi")
    ids = F.transform("anchors", lambda a: a["id"])
    rows = rows.filter(F.size(F.array_except("anchor_ids", ids)) == 0).withColumn("anchor_ids", cite(F.col("anchor_ids"), F.col("anchors")))
    kinds = F.transform(F.filter("anchors", lambda a: F.array_contains(F.col("anchor_ids"), a["id"])), lambda a: a["kind"])
    rows = rows.filter(F.array_contains(kinds, "entrypoint") & F.arrays_overlap(kinds, F.array(*map(F.lit, BEHAVIOR))))
    # a generator, as a filter would be pushed below and sanitize all texts a second time
    said = F.inline(F.array_compact(F.array(sanitize_scenario(F.col("title"), F.col("setup"), F.col("actions"), F.col("expected")))))
    rows = rows.select("target_id", "ord", F.col("title").alias("_title"), "hunk_ids", "anchor_ids", said)
    once = W.partitionBy("target_id", "_title").orderBy("ord")
    rows = rows.withColumn("_n", F.row_number().over(once)).filter("_n = 1")
    return rows.select("target_id", "ord", "title", "setup", "actions", "expected", "hunk_ids", "anchor_ids")


def validate_summaries(summaries: DataFrame, hunks: DataFrame) -> DataFrame:
    """Change summaries that cite known hunks only and still say something. summaries: ord, summary, hunk_ids."""
    rows = integral(summaries, "ord", "hunk_ids", hunks).withColumn("summary", text.sanitize(F.col("summary")))
    return rows.filter("summary is not null")
