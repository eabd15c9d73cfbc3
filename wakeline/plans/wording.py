"""Queries of labels, hints, arguments, diagnostics, globs and documents over pages, events and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arguments, classify, paths, text
from ..operators import status
from ..operators.lineage import numbered
from ..sources import repository
from ..streaming import ingest, lifecycle
from . import bindings as b
from . import facts


def page_wording(spark, sf):
    """What a page's place is called, its hints, a label of its source, and how much of that is shown."""
    p = facts._page_paths(spark, sf).join(b.table(spark, sf, "pages").select("page_id", "html"), "page_id")
    html = F.col("html")
    return p.select(
        "page_id", text.display_route(F.concat(F.lit("app/"), F.col("path"), F.lit("/page.tsx"))).alias("route"), text.mermaid(html).alias("label"),
        F.array_join(paths.import_hints(F.concat("path", F.lit(".ts"))), ",").alias("hints"), F.length(text.excerpt(html)).cast("bigint").alias("n_shown"),
    )


def argument_rules(spark, sf):
    """Which of a customer's fields are positive whole numbers, behind a separator or not."""
    c = b.table(spark, sf, "customer")
    given = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("--"), F.col("c_custkey").cast("string"), F.col("c_name"))).otherwise(F.array(F.col("c_custkey").cast("string"), F.col("c_name")))
    own = arguments.positional(given)
    return c.select("c_custkey", F.size(own).cast("bigint").alias("n_arguments"), arguments.positive_integer(F.get(own, 0)).alias("key"), arguments.positive_integer(F.get(own, 1)).alias("name"), arguments.positive_integer(F.col("c_acctbal").cast("decimal(12,2)").cast("string")).alias("balance"))


#: What a call of guidance said, in turn.
SAID = ("Invalid value in schema", "API key is not configured", "HTTP authentication failed", "Rate limit reached", "Connection reset", "Bearer abc is invalid json", "odd", "Unsupported   parameter\n temperature")


def diagnostics(spark, sf):
    """The category of a failed call, and what of its words may be kept."""
    k = F.col("event_id")
    said = F.element_at(F.array(*map(F.lit, SAID)), (k % len(SAID) + 1).cast("int"))
    code = F.element_at(F.array(*map(F.lit, (400, 401, 404, 429, 503, 200))), (k % 6 + 1).cast("int"))
    kind = F.when(k % 25 == 0, "malformed_json")
    token = F.when(k % 3 == 0, F.col("props")).otherwise(F.concat_ws("-", "event_type", k.cast("string")))
    return b.table(spark, sf, "events").select("event_id", classify.guidance_failure(kind, code, said).alias("category"), classify.safe_diagnostic(code, said).alias("diagnostic"), classify.safe_token(token).alias("token"))


def event_documents(spark, sf):
    """The parsed properties of every event; a text that doesn't fit is an error."""
    return repository.document(b.table(spark, sf, "events").select("event_id", "props"), "props", "k long").select("event_id", "props.k")


def log_rows(spark, sf):
    """K9: a line of log for every supplier."""
    rows = b.table(spark, sf, "supplier").select("s_suppkey", "s_name")
    return lifecycle.log_lines(rows, "warn", "late", F.lit("2026-01-02 03:04:05").cast("timestamp"))


def status_document(spark, sf):
    """Regions and nations as one document."""
    return status.document(regions=b.table(spark, sf, "region").select("r_regionkey", "r_name").coalesce(1), nations=b.table(spark, sf, "nation").select("n_nationkey").coalesce(1))


def active_projects(spark, sf):
    """Active projects in order, with their place."""
    rows = b.table(spark, sf, "customer").select(F.col("c_nationkey").alias("repo_id"), F.concat(F.lit("apps/"), F.col("c_name")).alias("root_path"), (F.col("c_acctbal") > 0).alias("is_active"))
    return numbered(status.active_projects(rows), "place", "repo_id", "root_path")


GLOBS = ("fr/*", "*/2*", "**", "e?", "./en/*/")


def glob_matches(spark, sf):
    """the globs that match the place of a page."""
    rows = facts._page_paths(spark, sf).select("page_id", F.regexp_replace("path", "/$", "").alias("root"), F.explode(F.array(*map(F.lit, GLOBS))).alias("glob"))
    return rows.filter(paths.matches_glob(F.col("root"), F.col("glob"))).select("page_id", "glob")


#: A key for the signatures of events, with the pads that its code is made by.
SECRET = "s3cret"
INNER, OUTER = (bytes(c ^ pad for c in SECRET.encode().ljust(64, b"\0")) for pad in (0x36, 0x5C))


def signed_deliveries(spark, sf):
    """The answer to every event as a delivery: signed rightly, wrongly or not at all, some without an id."""
    k, body = F.col("event_id"), F.col("props")
    code = F.sha2(F.concat(F.lit(OUTER), F.unhex(F.sha2(F.concat(F.lit(INNER), body.cast("binary")), 256))), 256)
    signature = F.when(k % 3 == 0, F.concat(F.lit("sha256="), code)).when(k % 3 == 1, F.concat(F.lit("sha256="), F.substring(code, 2, 63), F.lit("x")))
    rows = b.table(spark, sf, "events").select("event_id", F.when(k % 11 == 0, "").otherwise(k.cast("string")).alias("delivery_id"), F.col("event_type").alias("event_name"), signature.alias("signature"), body.alias("body"))
    return ingest.signed(rows, SECRET).select("event_id", "response")


QUERIES = {f.__name__: f for f in (signed_deliveries, page_wording, argument_rules, diagnostics, event_documents, log_rows, status_document, active_projects, glob_matches)}
_SAID = "[" + ", ".join("'" + s.replace("\n", "' || chr(10) || '") + "'" for s in SAID) + "]"
ORACLES = {
    "signed_deliveries": "SELECT event_id, CASE WHEN event_id % 3 = 2 OR event_id % 11 = 0 THEN 400 WHEN event_id % 3 = 0 THEN 202 ELSE 401 END::INTEGER AS response FROM events",
    "page_wording": f"""
WITH {facts._PAGES}, h AS (SELECT *, list_filter(string_split(lower(path), '/'), lambda s: s NOT IN ('', 'src', 'index')) AS parts FROM p)
SELECT page_id, '/' || path AS route, replace(replace(replace(replace(html, '"', ''), chr(92), ''), chr(13), ' '), chr(10), ' ') AS label,
       array_to_string(list_filter(CASE WHEN parts[-1] = parts[-2] THEN [parts[-1]] ELSE [parts[-1], parts[-2]] END, lambda s: length(s) > 2), ',') AS hints, least(1600, length(html)) AS n_shown FROM h""",
    "argument_rules": "SELECT c_custkey, 2::BIGINT AS n_arguments, CASE WHEN c_custkey > 0 THEN c_custkey END AS key, NULL::BIGINT AS name, CASE WHEN c_acctbal > 0 AND c_acctbal = floor(c_acctbal) THEN c_acctbal::BIGINT END AS balance FROM customer",
    "diagnostics": f"""
WITH e AS (SELECT *, event_id % 8 AS m, [400, 401, 404, 429, 503, 200][event_id % 6 + 1] AS s, {_SAID}[event_id % 8 + 1] AS said FROM events)
SELECT event_id, CASE WHEN event_id % 25 = 0 THEN 'malformed_json' WHEN m = 1 THEN 'configuration' WHEN s = 401 OR m = 2 THEN 'authentication' WHEN s = 429 OR m = 3 THEN 'rate_limited' WHEN s = 503 OR m = 4 THEN 'provider_unavailable'
         WHEN s = 400 THEN 'provider_request_rejected' WHEN s = 404 THEN 'model_unavailable' ELSE 'unknown' END AS category,
       CASE WHEN s IN (400, 404) AND m IN (0, 7) THEN CASE m WHEN 0 THEN said ELSE 'Unsupported parameter temperature' END END AS diagnostic, CASE WHEN event_id % 3 <> 0 THEN event_type || '-' || event_id END AS token FROM e""",
    "event_documents": "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events",
    "log_rows": """SELECT '{"level":"warn","message":"late","time":"2026-01-02T03:04:05.000Z","s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '"}' AS line FROM supplier""",
    "status_document": """
SELECT '{"regions":[' || (SELECT string_agg('{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}', ',' ORDER BY r_regionkey) FROM region) || '],"nations":['
       || (SELECT string_agg('{"n_nationkey":' || n_nationkey || '}', ',' ORDER BY n_nationkey) FROM nation) || ']}' AS document""",
    "active_projects": "SELECT c_nationkey AS repo_id, 'apps/' || c_name AS root_path, true AS is_active, row_number() OVER (ORDER BY c_nationkey, c_name) AS place FROM customer WHERE c_acctbal > 0",
    "glob_matches": f"""
WITH {facts._PAGES}, r AS (SELECT page_id, regexp_replace(path, '/$', '') AS root FROM p), s AS (SELECT *, string_split(root, '/') AS n FROM r)
SELECT page_id, unnest(list_filter(['fr/*', '*/2*', '**', './en/*/'], lambda g: CASE g WHEN '**' THEN true ELSE len(n) = 2 AND n[1] <> '' AND n[2] <> '' AND CASE g WHEN 'fr/*' THEN n[1] = 'fr' WHEN './en/*/' THEN n[1] = 'en' ELSE n[2][1:1] = '2' AND length(n[2]) > 1 END END)) AS glob FROM s""",
}
