"""The queries over documents and conversations against brute force on tables of a few rows."""

import re

from wakeline.plans import documents

MECHANICAL = re.compile(r"\b(?:typescript|typecheck|compile|compil(?:e|es|ation)|build(?:\s+check)?|lint(?:ing)?|eslint|prettier)\b", re.I | re.A)
NOUNS = re.compile(
    r"\b(?:imports?|exports?|analytics|telemetry|instrumentation|tracking|callbacks?|interfaces?|wiring|components?|hooks?|handlers?|functions?|props?)\b", re.I | re.A
)
BARE = re.compile(r"^(?:updates?|changes?|modifies?)\s+(?:for\s+)?[a-z0-9_-]+\.?$", re.I | re.A)


def sanitized(text):
    if text is None or MECHANICAL.search(text):
        return None
    out = re.sub(r"\s{2,}", " ", re.sub(r"\s+([,.;:!?])", r"\1", NOUNS.sub("", text), flags=re.A), flags=re.A).strip(" \t\n\r\f\v")
    return None if out == "" or BARE.search(out) else out


def put(tmp_path, spark, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))


LONG = "The cart shows the price of each item, and the total of them all at the very end of the page"


def test_sanitize_reads_whole_texts(spark, tmp_path):
    texts = [f"{LONG} lint", f"{LONG} , with a hook , and 3 more words.", f"{LONG}\n\nand TypeScript", f"{LONG} once more. " * 20, "Updates cart.", "Updates the cart.", "lint the cart", "components", "", " \n ", None]
    turns = [(7, i, "user", t) for i, t in enumerate(texts)]
    docs = [(i, t) for i, t in enumerate(texts)]
    put(tmp_path, spark, "conversations", turns, "conv_id long, turn long, role string, text string")
    put(tmp_path, spark, "documents", docs, "doc_id long, text string")
    got = {((r.conv_id, r.turn), r.doc_id): r.sanitized for r in documents.product_text_sanitize(spark, str(tmp_path)).collect()}
    want = {((7, i), None): sanitized(t) for i, t in enumerate(texts)} | {((None, None), i): sanitized(t) for i, t in enumerate(texts)}
    assert got == want
    assert want[(7, 0), None] is None and want[(None, None), 2] is None and len(want[(7, 3), None]) > 1000 and " hook" not in want[(7, 1), None]


def test_citations_of_all_documents_are_checked(spark, tmp_path):
    put(tmp_path, spark, "documents", [(i,) for i in range(9)], "doc_id long")
    put(tmp_path, spark, "labels", [(i,) for i in (0, 1, 2, 4, 5, 7)], "doc_id long")
    assert sorted(r.doc_id for r in documents.citation_integrity(spark, str(tmp_path)).collect()) == [0, 1, 4]


def test_budget_trim_takes_every_seventh_document_and_no_blank_one(spark, tmp_path):
    texts = {0: "a" * 3000, 1: " " * 50, 2: "", 7: "b" * 100, 14: "c " * 40, 15: "d", 21: " " * 1600 + "e", 28: None}
    put(tmp_path, spark, "documents", [(i, t, "en", "s") for i, t in texts.items()], "doc_id long, text string, lang string, source string")
    want, left = [], 9000
    for path in sorted(map(str, texts)):
        cut = (texts[int(path)] or "")[: min(1600, left)]
        if len(want) < 8 and left > 0 and cut.strip(" "):
            want.append((len(want), path, "entrypoint", len(cut)))
            left -= len(cut)
    got = sorted((r.pos, r.path, r.kind, r.n_chars) for r in documents.budget_trim(spark, str(tmp_path)).collect())
    assert got == want and [w[1] for w in want] == ["0", "14", "15", "7"]
