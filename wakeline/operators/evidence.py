"""Evidence: line differences, hunks, anchors under a budget, and what may be cited."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import linediff, paths
from .lineage import cut

#: Context lines, characters of an excerpt and of a target, anchors of a target, and the order of anchor kinds.
CONTEXT, EXCERPT, TARGET, ANCHORS = 3, 1600, 9000, 8
PRIORITY = {"changed_declaration": 0, "entrypoint": 1, "interaction": 2, "state": 3, "api_contract": 3, "dependency_use": 4, "test": 5}
#: Characters of a hint that paths are met by, at most.
GRAM = 32
BEHAVIOR = ("interaction", "state", "api_contract", "test")


def gap_groups(rows: DataFrame, key: str, at: str, gap: int = 2 * CONTEXT + 1) -> DataFrame:
    """Adds ``hunk``: rows of a key in order, a new number where the gap to the row before is larger."""
    order = W.partitionBy(key).orderBy(at)
    new = F.coalesce((F.col(at) - F.lag(at).over(order) > gap).cast("int"), F.lit(0))
    return rows.withColumn("_new", new).withColumn("hunk", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)).cast("bigint")).drop("_new")


def trim(anchors: Column, budget: int = TARGET, most: int = ANCHORS) -> Column:
    """Of anchors in order, those that fit: blank ones cost nothing, each is cut to what is left.

    anchors: array of struct with kind, path, start_line, end_line, excerpt.
    Anchors of one kind at one place count once. An ordered fold: what is
    skipped doesn't use the budget, so no running sum says the same.
    """
    kept = F.filter(F.transform(anchors, lambda a: a), lambda a: F.lit(False))
    start = F.struct(kept.alias("kept"), F.lit(budget).alias("left"))

    def step(state: Column, a: Column) -> Column:
        cut = F.substring(a["excerpt"], 1, F.least(F.lit(EXCERPT), state["left"]))
        seen = F.exists(state["kept"], lambda k: (k["kind"] == a["kind"]) & (k["path"] == a["path"]) & (k["start_line"] == a["start_line"]) & (k["end_line"] == a["end_line"]))
        fits = ~seen & (F.size(state["kept"]) < most) & (state["left"] > 0) & (F.trim(cut) != "")
        added = F.struct(F.concat(state["kept"], F.array(a.withField("excerpt", cut))).alias("kept"), (state["left"] - F.length(cut)).alias("left"))
        return F.when(fits, added).otherwise(state)

    return F.aggregate(anchors, start, step, lambda s: s["kept"])


def in_priority(anchors: Column) -> Column:
    """Anchors by kind, then path, then line."""
    rank = F.create_map(*[F.lit(x) for pair in PRIORITY.items() for x in pair])
    keyed = F.transform(anchors, lambda a, i: F.struct(F.element_at(rank, a["kind"]).alias("rank"), a["path"].alias("path"), a["start_line"].alias("line"), i.alias("i"), a.alias("a")))
    return F.transform(F.array_sort(keyed), lambda s: s["a"])


def nominees(anchors: DataFrame, *group: str) -> DataFrame:
    """Of each group's anchors those that ``trim`` could keep, so that a group to gather is small however many anchors it has.

    Whether an anchor fits depends on what is left and on the blanks it begins
    with. Of anchors that begin with as many, a later one fits only if all
    earlier ones did, so the first ANCHORS places of each number of blanks are
    enough: at most ANCHORS * EXCERPT rows, and exact.
    """
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in PRIORITY.items() for x in pair]), F.col("kind")), F.lit(-1))
    place = ["kind", "path", "start_line", "end_line"]
    shown = anchors.withColumn("excerpt", F.substring("excerpt", 1, EXCERPT)).withColumn("blanks", F.length("excerpt") - F.length(F.ltrim("excerpt"))).filter("blanks < length(excerpt)")
    once = shown.groupBy(*group, "blanks", *place).agg(F.min("excerpt").alias("excerpt"))
    return top_per_group(once, [*group, "blanks"], [rank, "path", "start_line", "kind", "end_line"], ANCHORS).drop("blanks")


def top_per_group(rows: DataFrame, group: list[str], order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each group."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")


def histogram(anchors: DataFrame) -> DataFrame:
    """A16."""
    return anchors.groupBy("kind").agg(F.count("*").alias("n"))


def first_references(hunks: DataFrame) -> DataFrame:
    """The first hunk of each path and symbol."""
    rest = [c for c in hunks.columns if c not in ("path", "symbol_name")]
    return hunks.groupBy("path", F.coalesce("symbol_name", F.lit("")).alias("symbol_name")).agg(F.min_by(F.struct(*rest), "ord").alias("h")).select("path", "symbol_name", "h.*")


def seed_ranks(candidates: DataFrame) -> DataFrame:
    """The first place of each seed among the candidates."""
    return candidates.groupBy(F.col("changed_seed_path").alias("path")).agg(F.min("ord").alias("rank"))


def rank_files(files: DataFrame, ranks: DataFrame) -> DataFrame:
    """Relevant, showable changed files by seed rank, those without last, then by path."""
    shown = files.filter("graph_relevant").filter(paths.is_shown(F.col("path")) & ~paths.is_test(F.col("path")))
    return shown.join(ranks, "path", "left").orderBy(F.coalesce("rank", F.lit(2**53 - 1)), "path")


def order_hunks(hunks: DataFrame, candidates: DataFrame) -> DataFrame:
    """The first hunk of each candidate's seed in candidate order, then the rest in theirs."""
    first = hunks.groupBy("path").agg(F.min("ord").alias("ord")).join(seed_ranks(candidates), "path")
    return hunks.join(first, ["path", "ord"], "left").orderBy(F.coalesce("rank", F.lit(2**53 - 1)), "ord")


def scenario_candidates(items: DataFrame) -> DataFrame:
    """A row for each primary or secondary supporting path of each primary or secondary item."""
    wanted = ("primary", "secondary")
    rows = items.filter(F.col("tier").isin(*wanted)).select("path", "kind", "project_root", "route_path", "http_method", "tier", F.explode("supporting_paths").alias("s"))
    rows = rows.filter(F.col("s.tier").isin(*wanted))
    return rows.select("path", "kind", "project_root", "route_path", "http_method", "tier", "s.impact", "s.changed_seed_path", "s.technical_role", "s.dependency_path")


def grounded(kind: Column, anchors: Column) -> Column:
    """An entrypoint anchor, and behaviour that fits the kind."""
    has = lambda *kinds: F.exists(anchors, lambda a: a["kind"].isin(*kinds))
    return has("entrypoint") & F.when(kind == "page", has("interaction", "state", "test")).otherwise(has("api_contract", "test"))


def related_tests(tree: DataFrame, hints: DataFrame, most: int = 8) -> DataFrame:
    """The first test paths of the tree (by ``ord``) that name a hint: hold its text, whatever the case.

    A path meets the hints by equality of its texts of their lengths; of a hint
    longer than GRAM the first GRAM characters are met, then the whole is looked for.
    """
    asked = cut(hints.filter("hint <> ''").select(F.col("hint"), F.substring("hint", 1, GRAM).alias("gram")).distinct())
    sizes = sorted(r.n for r in asked.select(F.length("gram").alias("n")).distinct().collect())
    parts = int(tree.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tests = tree.filter(paths.is_test(F.col("path"))).select("path", "ord", F.lower("path").alias("low")).repartition(parts)
    at = F.explode(F.sequence(F.lit(1), F.length("low")))
    keyed = tests.select("path", "ord", "low", at.alias("at")).select("path", "ord", "low", F.explode(F.array(*[F.substring(F.col("low"), F.col("at"), F.lit(n)) for n in sizes])).alias("gram"))
    named = keyed.join(asked, "gram").filter(F.contains("low", F.col("hint")))
    return named.groupBy("path").agg(F.min("ord").alias("ord")).orderBy("ord").limit(most)


def script_hunks(script: list[tuple[str, str]]) -> list[tuple[int, int, int, int, str, str]]:
    """Before and after line ranges and excerpts of each group of changes with its context."""
    changed = [i for i, (kind, _) in enumerate(script) if kind != "equal"]
    groups: list[list[int]] = []
    for i in changed:
        if groups and i - groups[-1][1] <= 2 * CONTEXT + 1:
            groups[-1][1] = i
        else:
            groups.append([i, i])
    olds, news = [0], [0]
    for kind, _ in script:
        olds.append(olds[-1] + (kind != "insert"))
        news.append(news[-1] + (kind != "delete"))
    out = []
    for first, last in groups:
        low, high = max(0, first - CONTEXT), min(len(script), last + CONTEXT + 1)
        old = "\n".join(line for kind, line in script[low:high] if kind != "insert")[:EXCERPT]
        new = "\n".join(line for kind, line in script[low:high] if kind != "delete")[:EXCERPT]
        if old or new:
            out.append((olds[low] + 1, olds[low] + 1 + old.count("\n"), news[low] + 1, news[low] + 1 + new.count("\n"), old, new))
    return out


HUNK = "before_start_line int, before_end_line int, after_start_line int, after_end_line int, before_excerpt string, after_excerpt string"


def hunks(pairs: DataFrame) -> DataFrame:
    """The hunks of each pair (path, revision, before, after): path, revision, ord and HUNK's columns.

    Of the shortest scripts that one counts whose every edit, from the last to
    the first, comes from the diagonal that reached further, a deletion on ties.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "revision", "ord", *[c.split()[0] for c in HUNK.split(", ")]]
        kinds = [pa.string(), pa.string(), *[pa.int32()] * 5, pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for path, revision, before, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                script = linediff.script(before.split("\n") if before else [], after.split("\n") if after else [])
                rows += [(path, revision, i, *h) for i, h in enumerate(script_hunks(script))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names)

    return pairs.select("path", "revision", "before", "after").mapInArrow(run, f"path string, revision string, ord int, {HUNK}")



def enclosing(hunks_: DataFrame, declarations: DataFrame) -> DataFrame:
    """Hunks with the narrowest declaration that overlaps their changed lines, the first in order on ties.

    hunks_: path, ord, changed_start, changed_end. declarations: path, name,
    kind, start_line, end_line, decl_ord. An equi-join on the path bounds the
    overlap test to one file.
    """
    rows = hunks_.join(declarations, "path", "left").filter("start_line is null or (start_line <= changed_end and end_line >= changed_start)")
    best = rows.filter("start_line is not null").groupBy("path", "ord").agg(F.min_by(F.struct("name", "kind"), F.struct(F.col("end_line") - F.col("start_line"), F.col("decl_ord"))).alias("d"))
    return hunks_.join(best, ["path", "ord"], "left").select(*hunks_.columns, F.col("d.name").alias("symbol_name"), F.col("d.kind").alias("symbol_kind"))
