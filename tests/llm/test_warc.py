import io

import pytest

from wakeline.llm import warc as x

PAGES = "page_id long, url string, html string"


def archive(payloads):
    return b"".join(x.encode_record(i, f"http://e/{i}", p, x.base32_sha1(p), None, False) for i, p in enumerate(payloads))


def test_every_split_reads_each_record_once():
    payloads = [b"a" * 10, b"", b"\x1f\x8b\x08 not a member \x1f\x8b\x08", bytes(range(256)) * 20, b"z"]
    data = archive(payloads)
    for size in (1, 7, 64, 200, len(data)):
        got = []
        for start in range(0, len(data), size):
            got += [x.decode_record(m) for _, m in x.members(io.BytesIO(data), start, min(start + size, len(data)), len(data))]
        assert [g[0] for g in got] == list(range(5)) and [g[6] for g in got] == payloads


def test_small_reads(monkeypatch):
    monkeypatch.setattr(x, "READ_BYTES", 16)
    payloads = [b"q" * 100, b"r" * 1000]
    data = archive(payloads)
    assert [x.decode_record(m)[6] for _, m in x.members(io.BytesIO(data), 0, len(data), len(data))] == payloads


@pytest.mark.parametrize("harm", ["checksum", "header", "middle", "cut", "start"])
def test_damage_is_told_once_by_some_range(harm):
    parts = [archive([bytes([65 + i]) * 300]) for i in range(3)]
    second = len(parts[0])
    whole = {
        "checksum": parts[0] + parts[1][:-6] + b"\0" * 6 + parts[2],
        "header": parts[0] + b"\0" * 12 + parts[1][12:] + parts[2],
        "middle": parts[0] + parts[1][:40] + b"\xff" * 10 + parts[1][50:] + parts[2],
        "cut": parts[0] + parts[2] + parts[1][:30],
        "start": b"\0" * 12 + parts[1][12:] + parts[0] + parts[2],
    }[harm]
    place = {"cut": second + len(parts[2]), "start": 0}.get(harm, second)
    for size in (1, 9, 50, second, second + 1, len(whole)):
        got = [m for s in range(0, len(whole), size) for m in x.members(io.BytesIO(whole), s, min(s + size, len(whole)), len(whole))]
        assert [x.decode_record(d)[6][:1] for _, d in got if d is not None] == [b"A", b"C"]
        assert [at for at, d in got if d is None] == [place], size


def test_damage_fails_or_is_reported(spark, tmp_path):
    path = tmp_path / "h"
    x.write(spark.createDataFrame([(i, "u", str(i) * 50) for i in range(6)], PAGES).coalesce(1), str(path))
    (file,) = path.glob("part-*.warc.gz")
    data = bytearray(file.read_bytes())
    at = [a for a, _ in x.members(io.BytesIO(data), 0, len(data), len(data))][2]
    data[at : at + 10] = b"\0" * 10
    file.write_bytes(data)
    with pytest.raises(Exception, match=f"byte {at}: not a whole"):
        x.read(spark, str(path)).collect()
    got = x.read(spark, str(path), damaged="skip", split=100).collect()
    assert sorted(r.record_type for r in got) == ["damaged", *["response"] * 5]
    assert [r.payload_bytes for r in got if r.record_type == "damaged"] == [at]


def test_two_writes_are_both_read(spark, tmp_path):
    path = str(tmp_path / "two")
    x.write(spark.createDataFrame([(1, "a", "xx")], PAGES), path)
    x.write(spark.createDataFrame([(2, "b", "yy")], PAGES), path)
    assert sorted(r.page_id for r in x.read(spark, path).collect()) == [1, 2]
    x.records(spark.createDataFrame([(3, "c", "zz")], PAGES)).write.format("warc").mode("overwrite").save(path)
    assert [r.page_id for r in x.read(spark, path).collect()] == [3]


def test_other_columns_are_not_read(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "xx", "p", "d", 9, True)], PAGES + ", payload string, digest string, refers_to long, revisit boolean")
    x.write(rows, str(tmp_path / "e"))
    assert [(r.page_id, bytes(r.payload)) for r in x.read(spark, str(tmp_path / "e")).collect()] == [(1, b"xx")]


def test_header_tells_of_a_changed_payload():
    record = x.encode_record(1, None, b"abc", x.base32_sha1(b"abd"), None, False)
    with pytest.raises(ValueError, match="digest"):
        x.decode_record(next(x.members(io.BytesIO(record), 0, len(record), len(record)))[1])


def test_round_trip(spark, tmp_path):
    rows = [(5, "http://x/é %", "same"), (3, "u", "same"), (9, None, "same"), (1, "v", None), (2, "w", ""), (4, "y", "other" * 100_000), (None, "n", "same"), (7, "r", "twice"), (7, "r", "twice")]
    x.write(spark.createDataFrame(rows, PAGES), str(tmp_path / "a"))
    got = x.read(spark, str(tmp_path / "a"), split=1000).collect()
    assert sorted((r.page_id is None, r.page_id or 0, r.record_type, r.refers_to) for r in got) == [
        (False, 1, "response", None), (False, 2, "revisit", 1), (False, 3, "response", None), (False, 4, "response", None), (False, 5, "revisit", 3),
        (False, 7, "response", None), (False, 7, "response", None), (False, 9, "revisit", 3), (True, 0, "revisit", 3),
    ]
    by = {r.page_id: r for r in got}
    assert by[5].url == "http://x/é %" and by[9].url is None and by[5].payload is None and by[5].payload_bytes == 4
    assert bytes(by[4].payload).decode() == "other" * 100_000 and by[4].payload_digest == x.base32_sha1(b"other" * 100_000)
    assert by[2].payload_bytes == 0


def test_short_payloads_and_empty_table(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx")], PAGES)
    x.write(frame, str(tmp_path / "b"), least=3)
    assert {r.record_type for r in x.read(spark, str(tmp_path / "b")).collect()} == {"response"}
    x.write(frame.limit(0), str(tmp_path / "c"))
    assert x.read(spark, str(tmp_path / "c")).count() == 0


def test_uncommitted_files_are_not_read(spark, tmp_path):
    x.write(spark.createDataFrame([(1, "a", "xx")], PAGES), str(tmp_path / "d"))
    (tmp_path / "d" / "part-lost.warc.gz").write_bytes(archive([b"ghost"]))
    assert [r.page_id for r in x.read(spark, str(tmp_path / "d")).collect()] == [1]


def test_a_payload_of_many_pages(spark, monkeypatch):
    """Rows of a hot payload meet its first page by a broadcast, others in a shuffle; the same either way."""
    from wakeline.llm import vector_codes

    pages = spark.createDataFrame([(i, f"u{i}", "shared" if i % 2 else f"own {i // 4}") for i in range(60)] + [(None, "n", "shared"), (1, "u1", "shared")], "page_id long, url string, html string")
    told = []
    for hot in (1, 4, 1 << 20):
        monkeypatch.setattr(vector_codes, "HOT", hot)
        told.append(sorted((repr(r.page_id), r.refers_to, r.revisit) for r in x.records(pages).collect()))
    assert told[0] == told[1] == told[2]
    assert ("5", 1, True) in told[0] and ("1", None, False) in told[0] and ("None", 1, True) in told[0] and ("2", 0, True) in told[0]
