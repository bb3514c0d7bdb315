import random
import struct

import pytest

sentencepiece = pytest.importorskip("sentencepiece")

from logloom.llm import pieces  # noqa: E402

ALPHABET = " \n\tabcdeéñ日😀thein▁0x<>  .,'\x00 "


@pytest.fixture(scope="module")
def both():
    path = pieces.model_path()
    return pieces.transducer(path), sentencepiece.SentencePieceProcessor(model_file=path)


def test_encode_and_decode_equal_the_library(both):
    ours, library = both
    rng = random.Random(7)
    cases = ["", " ", "  ", "a", " a", "a ", "a  b", "\n", "a\n\nb", "▁", "x" * 5000, " " * 300 + "y", "the " * 500]
    cases += ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    for text in cases:
        ids = library.encode(text)
        assert ours.encode(text) == ids, repr(text)
        assert ours.decode(ids) == library.decode(ids), repr(text)


def test_normaliser_rules_equal_the_library(both):
    rules = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    blob = next(v for k, v in pieces._fields(rules.serialized_model_proto()) if k == 3)
    machine = pieces.Normaliser(pieces.RuleTrie(dict(pieces._fields(blob))[2]))
    rng = random.Random(5)
    marks = "ﬁ①½Ａｱﾌﾟﾞが\u3099か\u0301e\u0301\u030a한ᄒ\u1161\u11abx \u00a0\u200b日"
    texts = ["ﬁ x", "①②", "Ａｂｃ", "é", "½ kg", "한글", "plain", ""] + ["".join(rng.choice(marks) for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    for text in texts:
        assert machine.apply(text).split() == rules.normalize(text).replace("▁", " ").split(), repr(text)


def field(number, value):
    """A field of a protocol-buffer message."""
    if isinstance(value, float):
        return bytes([number << 3 | 5]) + struct.pack("<f", value)
    if isinstance(value, int):
        return bytes([number << 3]) + varint(value)
    data = value.encode() if isinstance(value, str) else value
    return bytes([number << 3 | 2]) + varint(len(data)) + data


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def unigram_model(fallback, rule=None):
    """A model file with pieces and scores by hand."""
    rng = random.Random(9)
    texts = ["▁", *"abcdeé", "▁a", "▁b", "ab", "bc", "abc", "cd", "▁the", "the", "de", "ed", "ede", "▁ab", "éa", "aa", "aaa", "e▁" [:1] + "d"]
    pieces_ = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    if fallback:
        pieces_ += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces_ += [(t, -1.0 - 9 * rng.random(), 1) for t in dict.fromkeys(texts)]
    out = b"".join(field(1, field(1, t) + field(2, score) + field(3, kind)) for t, score, kind in pieces_)
    out += field(2, field(3, 1) + (bytes([35 << 3 & 127 | 128, 2, 1]) if fallback else b""))
    blob = b""
    if rule:
        made = next(v for k, v in pieces._fields(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()) if k == 3)
        blob = field(2, dict(pieces._fields(made))[2])
    return out + field(3, field(1, rule or "identity") + blob + field(3, 1) + field(4, int(bool(rule))) + field(5, 1))


@pytest.mark.parametrize(("fallback", "rule"), [(False, None), (True, None), (False, "nmt_nfkc"), (True, "nfkc")])
def test_unigram_models_equal_the_library(fallback, rule):
    model = unigram_model(fallback, rule)
    library, ours = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.Transducer(model)
    rng = random.Random(3)
    cases = ["", " ", "abc", "the abcde", "xyz", "aaaa", "ééa  b", "日日 a"] + ["".join(rng.choice("abcdeé the xﬁ日") for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    for text in cases:
        ids = library.encode(text)
        assert ours.encode(text) == ids, repr(text)
        assert ours.decode(ids) == library.decode(ids), repr(text)


def test_whole_table_equals_the_library(spark, sf, both):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: both[1].encode(r.text or "") for r in docs.collect()}
    got = {r.doc_id: r.ids for r in pieces.op1_sentencepiece(spark, sf).collect()}
    assert got == want


def test_defined_results(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b", None), (2, "a b", "y"), (3, "longword" * 20000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = pieces.encode(docs)
    got = sorted(out.collect(), key=lambda r: (r.doc_id or 0, r.n_tokens))
    assert [(r.doc_id, r.n_tokens) for r in got][:3] == [(None, 2), (1, 0), (2, 0)]
    assert all(r.round_trip for r in got)
    back = {(r.doc_id, r.text) for r in pieces.decode(out).collect()}
    assert back == {(d, t or "") for d, t, _ in rows}
    assert pieces.encode(docs.limit(0)).count() == 0


def test_texts_are_normalised_once(monkeypatch):
    calls, plain = [], pieces.Transducer.normal
    monkeypatch.setattr(pieces.Transducer, "normal", lambda self, text: (calls.append(text), plain(self, text))[1])
    machine = pieces.Transducer(open(pieces.model_path(), "rb").read())
    ids = machine.encode_normal(machine.normal("Some  words"))
    assert ids == machine.encode_bytes("Some  words") and len(calls) == 2
