"""Encoding and decoding against the sentencepiece library, for the given model and for variants of it."""

import hashlib
import random

import numpy as np
import pytest

from wakeline.llm import pieces as x

sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def data():
    with open(public_tokenizers.path(x.MODEL), "rb") as file:
        return file.read()


def variant(data, rule=None, fixed=(), **settings):
    """The model with the character map of a rule of the library, further fixed pieces and other settings."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto.FromString(data)
    if rule:
        other = proto.ModelProto.FromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        model.normalizer_spec.precompiled_charsmap = other.normalizer_spec.precompiled_charsmap
    for name, value in settings.items():
        spec = model.normalizer_spec if hasattr(model.normalizer_spec, name) else model.trainer_spec
        setattr(spec, name, value)
    if settings.get("byte_fallback") is False:
        for p in model.pieces:
            if p.type == p.BYTE:
                p.type, p.piece = p.NORMAL, p.piece.replace("<0x", "<<0x")
    for text in fixed:
        found = [p for p in model.pieces if p.piece == text] or [model.pieces.add(piece=text, score=0.0)]
        found[0].type = model.pieces[0].USER_DEFINED
    return model.SerializeToString()


TEXTS = [
    "", " ", "   ", "a", " a", "a ", "  two  spaces  ", "Hello, world! It's 12345.67\n\tfoo();", "日本語のテキスト、ﬁne ①Ｈ２ｏ ½", "é é ñ ß İ ſ",
    "▁mark▁ ▁", "mark ▁", "\x00\x01​﻿­", "👩‍👩‍👧 \U0010ffff\U0001f600", "<s></s><unk><0x41>", "x" * 300, "aaaa" * 60 + "\n" * 70, "ab" * 100 + " " * 120 + "c", "　  wide　blank ", "한국어 텍스트 ㈜ ﷺ", "uṇ̀known \U00013000\U00013001x",
]


def texts(n=150):
    rng = random.Random(11)
    pool = [*"etaoin shrdlu", *"THE .,;:!?\n\t-_()[]{}", "the", " the", "ing ", "▁", "  ", "日", "本", "é", "ﬁ", "①", "́", "\U0001f600", "\x07", "中文", "　", "ß", "½"]
    return TEXTS + ["".join(rng.choices(pool, k=rng.randint(1, 60))) for _ in range(n)]


VARIANTS = {
    "given": {},
    "nmt_nfkc": {"rule": "nmt_nfkc"},
    "nfkc_cf, tidy": {"rule": "nfkc_cf", "remove_extra_whitespaces": True},
    "tidy": {"remove_extra_whitespaces": True},
    "no prefix": {"add_dummy_prefix": False},
    "no prefix, tidy": {"rule": "nmt_nfkc", "add_dummy_prefix": False, "remove_extra_whitespaces": True},
    "no bytes": {"byte_fallback": False},
    "suffix": {"treat_whitespace_as_suffix": True},
    "fixed": {"fixed": ("foo", "the", "the in", "日本"), "rule": "nmt_nfkc"},
}


@pytest.mark.parametrize("name", VARIANTS)
def test_equals_the_library(data, name):
    changed = variant(data, **VARIANTS[name])
    own, library = x.Model(changed), sentencepiece.SentencePieceProcessor(model_proto=changed)
    many = texts()
    for text, (ids, begins, ends) in zip(many, own.encode(many), strict=True):
        want = library.encode(text, add_bos=True, add_eos=True)
        assert ids.tolist() == want, repr(text)
        spans = [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        assert list(zip(begins.tolist(), ends.tolist(), strict=True))[1:-1] == spans, repr(text)
        assert own.decode(ids) == library.decode(want), repr(text)


def test_small_pieces_and_short_memory(data, monkeypatch):
    own = x.Model(data)
    many = texts(40)
    want = [[a.tolist() for a in row] for row in own.encode(many)]
    for name, value in (("PIECE", 7), ("KNOWN", 5), ("ROWS", 3), ("SHORT", 2)):
        monkeypatch.setattr(x, name, value)
        own.forget()
        assert [[a.tolist() for a in row] for row in own.encode(many)] == want, name


def test_decoding_of_any_ids(data):
    own, library = x.Model(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    rng = random.Random(12)
    for _ in range(300):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(32000), rng.randrange(3)]) for _ in range(rng.randint(0, 12))]
        assert own.decode(np.array(ids, np.int64)) == library.decode(ids), ids
    with pytest.raises(ValueError, match="vocabulary"):
        own.decode(np.array([32000]))


def test_rules_of_the_compiled_map():
    from sentencepiece import sentencepiece_model_pb2 as proto

    normalizer = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    rules = x.compiled_rules(proto.ModelProto.FromString(normalizer.serialized_model_proto()).normalizer_spec.precompiled_charsmap)
    assert rules["ﬁ"] == "fi" and rules["①"] == "1" and rules["　"] == " " and len(rules) > 10_000
    assert x.compiled_rules(b"") == {}


def test_frames(data, docs, spark):
    from conftest import AWKWARD

    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    rows = [*AWKWARD, (9, "tie"), (9, "tie"), (10, " ")]
    frame = docs([(*r, "en", "s", 1, "mine") for r in rows], ", ids string")
    encoded = x.encode(frame, data)
    assert encoded.columns == ["doc_id", "ids", "begins", "ends"]
    back = x.decode(encoded, data).collect()
    want = sorted((repr(i), library.encode(t or "", add_bos=True, add_eos=True)) for i, t in rows)
    assert sorted((repr(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in back) == want
    assert sorted((repr(r.doc_id), r.decoded) for r in back) == sorted((repr(i), library.decode(library.encode(t or ""))) for i, t in rows)
    assert x.encode(docs([]), data).count() == 0
    nulls = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert x.decode(nulls, data).collect()[0].decoded is None
    with pytest.raises(ValueError, match="decoded already"):
        x.decode(nulls.withColumn("decoded", nulls["doc_id"]), data)


def test_query(spark, data, tmp_path, docs):
    from conftest import AWKWARD

    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    rows = [*AWKWARD, *enumerate(texts(30), 100)]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(repr, ((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in x.op13_sentencepiece(spark, str(tmp_path)).collect())))
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, text in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want.append(repr((i, len(ids), digest(np.array(ids, "<u4").tobytes()), digest(library.decode(ids).encode()))))
    assert got == sorted(want)
