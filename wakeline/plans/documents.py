"""Queries of budgets, citations and wording over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import evidence, validate
from . import bindings as b


def _anchors(spark, sf):
    """Documents as anchors of their source's target: the kind by language, the text as far as an excerpt goes."""
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in (("en", "entrypoint"), ("de", "interaction"), ("fr", "state"), ("es", "test")) for x in pair]), F.col("lang"))
    line = (F.col("doc_id") % 50).cast("int")
    return b.table(spark, sf, "documents").select("source", kind.alias("kind"), F.col("doc_id").cast("string").alias("path"), line.alias("start_line"), line.alias("end_line"), text.excerpt(F.col("text")).alias("excerpt"))


def budget_trim(spark, sf):
    few = evidence.nominees(_anchors(spark, sf), "source").select("source", F.struct("kind", "path", "start_line", "end_line", "excerpt").alias("a"))
    rows = few.groupBy("source").agg(evidence.trim(evidence.in_priority(F.array_sort(F.collect_list("a")))).alias("kept"))
    return rows.select("source", F.posexplode("kept").alias("pos", "a")).select("source", F.col("pos").cast("bigint").alias("pos"), F.col("a.path").alias("path"), F.col("a.kind").alias("kind"), F.length("a.excerpt").cast("bigint").alias("n_chars"))


def anchor_topk(spark, sf):
    rows = b.table(spark, sf, "documents").select("source", "lang", "doc_id", "n_chars")
    return evidence.top_per_group(rows, ["source", "lang"], [F.desc("n_chars"), "doc_id"], 2)


def citation_integrity(spark, sf):
    known = b.table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    cited = b.table(spark, sf, "documents").select("doc_id", F.array("doc_id", F.col("doc_id") + 1).alias("ids"))
    return validate.integral(cited, "doc_id", "ids", known).select("doc_id")


def product_text_sanitize(spark, sf):
    """The whole text of each turn (conv_id, turn) and of each document (doc_id), sanitized."""
    turns = b.table(spark, sf, "conversations").select("conv_id", "turn", F.lit(None).cast("long").alias("doc_id"), "text")
    docs = b.table(spark, sf, "documents").select(F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turn"), "doc_id", "text")
    return turns.unionByName(docs).select("conv_id", "turn", "doc_id", text.sanitize(F.col("text")).alias("sanitized"))


def line_diff_hunks(spark, sf):
    docs = b.table(spark, sf, "documents").filter("text is not null")
    nxt = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("after"))
    pairs = docs.join(nxt, "doc_id").select(F.col("doc_id").cast("string").alias("path"), F.lit("head").alias("revision"), F.col("text").alias("before"), "after")
    return evidence.hunks(pairs)


# The wording rules stated apart from the engine's own patterns, word by word.
_BLOCKING = "typescript typecheck compile compiles compilation build lint linting eslint prettier".split()
_CUT = "import imports export exports analytics telemetry instrumentation tracking callback callbacks interface interfaces wiring component components hook hooks handler handlers function functions prop props".split()
_BARE = [f"{verb}{s}" for verb in ("update", "change") for s in ("", "s")] + ["modifie", "modifies"]
_WORDS = lambda words: r"(?i)\b(" + "|".join(sorted(words, key=len, reverse=True)) + r")\b"

QUERIES = {f.__name__: f for f in (budget_trim, anchor_topk, citation_integrity, product_text_sanitize, line_diff_hunks)}
ORACLES = {
    "budget_trim": """
WITH RECURSIVE a AS (
  SELECT source, doc_id::VARCHAR AS path, CASE lang WHEN 'en' THEN 'entrypoint' WHEN 'de' THEN 'interaction' WHEN 'fr' THEN 'state' ELSE 'test' END AS kind,
         CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3 ELSE 5 END AS rank, doc_id % 50 AS line, coalesce(text, '')[1:1600] AS excerpt FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank, path, line) AS i FROM a),
f AS (
  SELECT source, 0::BIGINT AS i, 9000::BIGINT AS budget, 0::BIGINT AS kept, NULL::VARCHAR AS path, NULL::VARCHAR AS kind, 0::BIGINT AS n_chars FROM o WHERE i = 1
  UNION ALL
  SELECT f.source, o.i, CASE WHEN fits THEN budget - least(1600, budget, length(excerpt)) ELSE budget END, CASE WHEN fits THEN kept + 1 ELSE kept END,
         CASE WHEN fits THEN o.path END, o.kind, CASE WHEN fits THEN least(1600, budget, length(excerpt)) ELSE 0 END
  FROM (SELECT f.*, o.i AS next, kept < 8 AND budget > 0 AND trim(excerpt[1:least(1600, budget)], ' ') <> '' AS fits FROM f JOIN o ON o.source = f.source AND o.i = f.i + 1) f
  JOIN o ON o.source = f.source AND o.i = f.next)
SELECT source, kept - 1 AS pos, path, kind, n_chars FROM f WHERE path IS NOT NULL""",
    "anchor_topk": "SELECT source, lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 2",
    "citation_integrity": "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id + 1 IN (SELECT doc_id FROM labels)",
    "product_text_sanitize": rf"""
WITH w AS (SELECT conv_id, turn, NULL::BIGINT AS doc_id, text AS t FROM conversations UNION ALL SELECT NULL, NULL, doc_id, text FROM documents),
s AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '{_WORDS(_CUT)}', '', 'g'), '\s+([,.;:!?])', '\1', 'g'), '\s{{2,}}', ' ', 'g'), '^\s+|\s+$', '', 'g') AS x FROM w)
SELECT conv_id, turn, doc_id, CASE WHEN NOT regexp_matches(t, '{_WORDS(_BLOCKING)}') AND NOT regexp_matches(x, '(?i)^({'|'.join(_BARE)})\s+(for\s+)?[a-z0-9_-]+\.?$') AND x <> '' THEN x END AS sanitized FROM s""",
    # the grid of edit distances, row by row; far: the furthest line of each diagonal for each number of edits;
    # back: from the end, the diagonal that reached further, a deletion on ties
    "line_diff_hunks": """
WITH RECURSIVE lines AS (SELECT doc_id, CASE WHEN text = '' THEN [] ELSE string_split(text, chr(10)) END AS l FROM documents WHERE text IS NOT NULL),
pairs AS MATERIALIZED (SELECT f.doc_id::VARCHAR AS path, f.l AS a, g.l AS b FROM lines f JOIN lines g ON g.doc_id = f.doc_id + 1),
grid AS (
  SELECT path, 0::BIGINT AS i, j, j AS d FROM pairs, unnest(range(len(b) + 1)) AS u(j)
  UNION ALL
  SELECT path, i, j, min(t - j) OVER (PARTITION BY path ORDER BY j) + j AS d FROM (
    SELECT path, i + 1 AS i, j, CASE WHEN j > 0 AND a[i + 1] = b[j] THEN lag(d) OVER (PARTITION BY path ORDER BY j) ELSE d + 1 END AS t
    FROM grid JOIN pairs USING (path) WHERE i < len(a))),
far AS MATERIALIZED (SELECT path, d, i - j AS k, max(i) AS x FROM grid GROUP BY ALL),
back AS (
  SELECT path, d, i AS x, j AS y, NULL::BOOLEAN AS ins FROM grid JOIN pairs USING (path) WHERE i = len(a) AND j = len(b)
  UNION ALL
  SELECT path, d, CASE WHEN ins THEN above ELSE below END AS x, CASE WHEN ins THEN above - k - 1 ELSE below - k + 1 END AS y, ins FROM (
    SELECT back.path, back.d - 1 AS d, back.x - back.y AS k, lower.x AS below, upper.x AS above, coalesce(lower.x, -2) < coalesce(upper.x, -2) AS ins
    FROM back LEFT JOIN far AS lower ON lower.path = back.path AND lower.d = back.d - 1 AND lower.k = back.x - back.y - 1
    LEFT JOIN far AS upper ON upper.path = back.path AND upper.d = back.d - 1 AND upper.k = back.x - back.y + 1 WHERE back.d > 0)),
edits AS MATERIALIZED (SELECT path, x, y, ins, (x + y + d) // 2 AS spot FROM back WHERE ins IS NOT NULL),
befores AS (SELECT path, x, a[x + 1] AS line, x + (SELECT count(*) FROM edits e WHERE e.path = p.path AND e.ins AND e.x <= u.x) AS spot FROM pairs p, unnest(range(len(a))) AS u(x)),
afters AS (SELECT path, y, b[y + 1] AS line, y + (SELECT count(*) FROM edits e WHERE e.path = p.path AND NOT e.ins AND e.y <= u.y) AS spot FROM pairs p, unnest(range(len(b))) AS u(y)),
groups AS (
  SELECT path, g, min(spot) - 3 AS low, max(spot) + 3 AS high FROM (
    SELECT path, spot, sum(new) OVER (PARTITION BY path ORDER BY spot) AS g FROM (
      SELECT path, spot, (coalesce(spot - lag(spot) OVER (PARTITION BY path ORDER BY spot), 99) > 7)::INT AS new FROM edits)) GROUP BY ALL),
hunks AS (
  SELECT path, g, (SELECT count(*) FROM befores l WHERE l.path = q.path AND l.spot < low) + 1 AS b0, (SELECT count(*) FROM afters l WHERE l.path = q.path AND l.spot < low) + 1 AS a0,
         coalesce((SELECT string_agg(line, chr(10) ORDER BY x) FROM befores l WHERE l.path = q.path AND l.spot BETWEEN low AND high), '')[1:1600] AS bx,
         coalesce((SELECT string_agg(line, chr(10) ORDER BY y) FROM afters l WHERE l.path = q.path AND l.spot BETWEEN low AND high), '')[1:1600] AS ax
  FROM groups q)
SELECT path, 'head' AS revision, (row_number() OVER (PARTITION BY path ORDER BY g) - 1)::INTEGER AS ord, b0::INTEGER AS before_start_line,
       (b0 + len(bx) - len(replace(bx, chr(10), '')))::INTEGER AS before_end_line, a0::INTEGER AS after_start_line, (a0 + len(ax) - len(replace(ax, chr(10), '')))::INTEGER AS after_end_line,
       bx AS before_excerpt, ax AS after_excerpt FROM hunks WHERE bx <> '' OR ax <> ''""",
}
