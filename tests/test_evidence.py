"""Differences, hunks, budgets, validation and report text."""

import random

import pytest
from pyspark.sql import functions as F

from wakeline.functions import linediff, text
from wakeline.operators import evidence, report, validate


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_script_is_shortest_and_right():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        script = linediff.script(a, b)
        assert [x for k, x in script if k != "insert"] == a and [x for k, x in script if k != "delete"] == b
        assert sum(k == "equal" for k, _ in script) == lcs(a, b)


def test_two_hunks(spark):
    before = "\n".join(f"line {i}" for i in range(40))
    after = before.replace("line 3\n", "line three\n").replace("line 30\n", "line 30\nmore\n")
    pairs = spark.createDataFrame([("a.ts", "head", before, after), ("b.ts", "head", "same", "same"), ("c.ts", "head", "", "new\n")], "path string, revision string, before string, after string")
    got = evidence.hunks(pairs).orderBy("path", "ord").collect()
    assert [(r.path, r.before_start_line, r.before_end_line, r.after_start_line, r.after_end_line) for r in got] == [("a.ts", 1, 7, 1, 7), ("a.ts", 29, 34, 29, 35), ("c.ts", 1, 1, 1, 2)]
    assert "line three" in got[0].after_excerpt and "line three" not in got[0].before_excerpt


def test_narrowest_declaration(spark):
    h = spark.createDataFrame([("a", 0, 5, 5), ("a", 1, 50, 51)], "path string, ord int, changed_start int, changed_end int")
    d = spark.createDataFrame([("a", "Outer", "class", 1, 20, 0), ("a", "inner", "function", 4, 6, 1)], "path string, name string, kind string, start_line int, end_line int, decl_ord int")
    assert [(r.ord, r.symbol_name) for r in evidence.enclosing(h, d).orderBy("ord").collect()] == [(0, "inner"), (1, None)]


def test_budget(spark):
    rows = [("entrypoint", "p", i, i, "x" * 2000 if i % 2 else " ") for i in range(12)] + [("entrypoint", "p", 1, 1, "again")]
    kept = spark.range(1).select(evidence.trim(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("kind", "path", "start_line", "end_line", "excerpt"), r, strict=True)]) for r in rows])).alias("k")).first().k
    assert [len(a.excerpt) for a in kept] == [1600] * 5 + [1000] and [a.start_line for a in kept] == [1, 3, 5, 7, 9, 11]


def test_node_budget(spark):
    paths = [["a", "b"], ["c", "d", "e"], ["b", "f"]]
    got = spark.range(1).select(report.within_budget(F.lit(paths), 4).alias("k")).first().k
    assert got == [["a", "b"], ["b", "f"]]
    assert spark.range(1).select(report.within_budget(F.lit([["a", "b", "c"]]), 2).alias("k")).first().k == [["a", "b", "c"]]


ANCHOR = "array<struct<id:string,kind:string>>"
TARGET = f"target_id string, kind string, path string, changed_seed_path string, dependency_path array<string>, api_verification_allowed boolean, anchors {ANCHOR}"
SCENARIO = "answer_ord int, target_id string, ord int, title string, setup string, actions array<string>, expected array<string>, hunk_ids array<string>, anchor_ids array<string>"


@pytest.mark.parametrize(
    ("change", "stands"),
    [
        ({}, True),
        ({"hunk_ids": ["h1", "nope"]}, False),
        ({"hunk_ids": ["h2"]}, False),
        ({"anchor_ids": ["other"]}, False),
        ({"title": "Run the lint"}, False),
        ({"actions": []}, False),
        ({"setup": "build check"}, False),
        ({"expected": ["updates cart."]}, False),
        ({"title": "[entry::web::page] Check out"}, True),
        ({"answer_ord": 5}, True),
        ({"target_id": "gone"}, False),
        ({"target_id": "api"}, False),
    ],
)
def test_validation(spark, change, stands):
    targets = spark.createDataFrame(
        [("t", "page", "p", "s", ["s", "p"], False, [("a1", "entrypoint"), ("a2", "interaction")]), ("api", "api_route", "p", "s", ["s", "p"], False, [("a1", "entrypoint"), ("a2", "test")])], TARGET
    )
    hunks = spark.createDataFrame([("h1", "s"), ("h2", "elsewhere")], "id string, path string")
    base = {"answer_ord": 0, "target_id": "t", "ord": 0, "title": "Check out", "setup": None, "actions": ["Open the component cart"] * 5, "expected": ["It shows"], "hunk_ids": ["h1"], "anchor_ids": []} | change
    got = validate.validate(spark.createDataFrame([tuple(base.values())], SCENARIO), targets, hunks).collect()
    assert bool(got) == stands
    if stands:
        assert got[0].anchor_ids == ["a1", "a2"] and got[0].title == "Check out" and got[0].actions == ["Open the cart"] * 3


def test_first_answer_and_repeated_titles(spark):
    targets = spark.createDataFrame([("t", "page", "p", "s", ["s", "p"], False, [("a1", "entrypoint"), ("a2", "state")])], TARGET)
    hunks = spark.createDataFrame([("h1", "s")], "id string, path string")
    row = lambda answer, ord_, title, hunk="h1": (answer, "t", ord_, title, None, ["Do"], ["See"], [hunk], [])
    rows = [row(0, 0, "A", "bad"), row(0, 1, "A"), row(0, 2, "A"), row(1, 0, "B")]
    assert [r.ord for r in validate.validate(spark.createDataFrame(rows, SCENARIO), targets, hunks).collect()] == [1]


def test_wording(spark):
    row = spark.range(1).select(
        text.heading(F.lit('<h1 class="x"> A <b>big</b> &amp;  small </h1>')).alias("h"), text.heading(F.lit("<h2>no</h2>")).alias("n"), text.humanize_segment(F.lit("[orderId]")).alias("s"),
        text.display_route(F.lit("src/app/cart/page.tsx")).alias("r"), text.display_route(F.lit("pages/index.js")).alias("i"), text.mermaid(F.lit('a"b\n')).alias("m"), F.size(text.lines(F.lit(""))).alias("z"), F.size(text.lines(F.lit("a\n"))).alias("l"),
    ).first()
    assert tuple(row) == ("A big & small", None, "Order ID", "/cart", "/", "ab ", 0, 2)


def test_comment_bodies(spark):
    states = spark.createDataFrame([("building", None), ("ready", "# Report\n"), ("insufficient_evidence", None), ("failed", None)], "status string, markdown string")
    body = text.comment_body(F.col("status"), F.lit("b1"), F.lit("h1"), text.marker(F.lit(7), F.lit(3)), F.col("markdown"))
    got = {r.status: r.body for r in states.select("status", body.alias("body")).collect()}
    assert got["building"].startswith("## What this change reaches\n\nWorking on `h1`;") and got["ready"].startswith("# Report\n\n---")
    assert all(b.endswith("<!-- wakeline:repository=7:change=3 -->") for b in got.values())
    with pytest.raises(Exception, match="no ready report"):
        states.filter("status = 'ready'").withColumn("markdown", F.lit(None).cast("string")).select(body).collect()


def test_report(spark):
    items = spark.createDataFrame(
        [("app/x.tsx", "page", None, "/x", None, "primary", "indirect", "lib/a.ts", "application", ["lib/a.ts", "app/x.tsx"], [("primary", "indirect", "lib/a.ts", "application", ["lib/a.ts", "app/x.tsx"])])],
        "path string, kind string, project_root string, route_path string, http_method string, tier string, impact string, changed_seed_path string, technical_role string, dependency_path array<string>, "
        "supporting_paths array<struct<tier:string,impact:string,changed_seed_path:string,technical_role:string,dependency_path:array<string>>>",
    )
    symbols = spark.createDataFrame([("lib/a.ts:function:priceOf", "modified")], "symbol_key string, change_kind string")
    named = spark.createDataFrame([("lib/a.ts", "lib/a.ts:function:priceOf", "priceOf")], "file_path string, symbol_key string, name string")
    files = spark.createDataFrame([("lib/a.ts", "modified")], "path string, status string")
    got = report.render(items, symbols, files, named, "b", "h", unresolved=2).first().markdown
    for line in ("## Change Impact Report", "Modified `priceOf`.", "flowchart LR", '  n1["X page (page)"]', '  n2["Price Of (changed)"]', "  n2 --> n1", "  class n2 changed", "  class n1 entrypoint", "- 2 unresolved import(s)", "Analyzed base `b` → head `h`"):
        assert line in got.split("\n"), (line, got)
    assert "makes no impact claims because nothing" in report.render(items, symbols, files, named, "b", "h", reason="nothing").first().markdown


def test_report_with_scenarios_and_details(spark):
    path = "tier string, impact string, changed_seed_path string, technical_role string, dependency_path array<string>"
    item = lambda p, route, tier, way: (p, "page", None, route, None, tier, "indirect", way[0], "application", way, [(tier, "indirect", way[0], "application", way)])
    items = spark.createDataFrame(
        [item("app/b.tsx", "/b", "primary", ["lib/z.ts", "app/b.tsx"]), item("app/a.tsx", "/a", "primary", ["lib/a.ts", "lib/m.ts", "app/a.tsx"]), item("app/c.tsx", "/c", "technical_only", ["lib/a.ts", "app/c.tsx"])],
        f"path string, kind string, project_root string, route_path string, http_method string, {path}, supporting_paths array<struct<{path.replace(' array', ': array').replace(' string', ':string')}>>",
    )
    symbols = spark.createDataFrame([], "symbol_key string, change_kind string")
    named = spark.createDataFrame([], "file_path string, symbol_key string, name string")
    files = spark.createDataFrame([("lib/a.ts", "modified")], "path string, status string")
    scenarios = spark.createDataFrame([("entry::page::/b", 1, "Second", None, ["go"], ["seen"], True), ("entry::page::/b", 0, "First", "log in", ["open", "click"], ["ok"], True)], "target string, ord int, title string, setup string, actions array<string>, expected array<string>, uses boolean")
    chosen = spark.createDataFrame([("entry::page::/b",)], "target string")
    headings = spark.createDataFrame([("entry::page::/b", 0, "The B")], "target string, ord int, heading string")
    got = report.render(items, symbols, files, named, "b", "h", scenarios=scenarios, chosen=chosen, headings=headings).first().markdown
    at = [got.index(x) for x in ("1. **First**\n   _Where: The B_", "   **First:** log in", "   - open\n   - click", "   - ok", "**Reason:** The page uses the changed Z module.", "2. **Second**", "### Impact map", "</details>")]
    assert at == sorted(at)
    assert "- 1 more reached entrypoint has too little" in got
    # numbered by locale, arrows and classes as the ranked paths meet them: b's path first
    lines = got.split("\n")
    number = {x.split('["')[1]: x.strip().split("[")[0] for x in lines if x.startswith("  n") and '["' in x}
    b, a, c, la, lm, lz = (number[k] for k in ('The B (page)"]', 'A page (page)"]', 'C page (page)"]', 'A module (changed)"]', 'M module"]', 'Z module (changed)"]'))
    assert [x for x in lines if "-->" in x or "-.->" in x] == [f"  {lz} --> {b}", f"  {la} --> {lm}", f"  {lm} --> {a}", f"  {la} -.-> {c}"]
    assert f"  class {lz},{la} changed" in lines and f"  class {b},{a},{c} entrypoint" in lines
    none = report.render(items.limit(0), symbols, files, named, "b", "h").first().markdown
    assert report.NO_PATH in none and "classDef" not in none


def test_evidence_ids(spark):
    items = spark.createDataFrame([("a.ts", "page", None, "/x", None, "direct", ["a.ts"]), ("b.ts", "api_route", "app", None, "GET", "direct", ["b.ts"])], "path string, kind string, project_root string, route_path string, http_method string, impact string, dependency_path array<string>")
    symbols = spark.createDataFrame([("a.ts:function:f", "f", "added", "a.ts")], "symbol_key string, name string, change_kind string, file_path string")
    own, told = report.evidence(items, symbols)
    assert [r.id for r in own.collect()] == ["affected:app:api_route:GET:b.ts", "affected::page::/x"] and told.first().id == "symbol:a.ts:function:f"
    with pytest.raises(Exception, match="no dependency path"):
        report.evidence(items.withColumn("dependency_path", F.array().cast("array<string>")), symbols)[0].collect()
