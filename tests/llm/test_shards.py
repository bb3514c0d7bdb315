import random
import struct
import zlib

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")

from logloom.llm import shards as S  # noqa: E402


def test_ids_equal_the_library():
    plain = tokenizers.Tokenizer.from_file(S.tokenizer_path())
    rng = random.Random(3)
    alphabet = " \n\tabc'deé日  \xa0.,1<|endoftext|>!?\x1c s"
    texts = ["", " ", "a<|endoftext|>b", "it's  we'll\n\n\nx y", " lead", "trail ", "\nx", "a \nb"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    own = S.Encoder(S.tokenizer_path())
    for _ in range(2):
        got = own.encode(texts)
        assert got == [np.array(plain.encode(t, add_special_tokens=False).ids, f"<u{own.width}").tobytes() for t in texts]


def test_shards_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plain = tokenizers.Tokenizer.from_file(S.tokenizer_path())
    want, start = [], 0
    for r in docs.orderBy("doc_id").collect():
        ids = [*plain.encode(r.text, add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    manifest = S.write(docs)
    assert sorted(map(tuple, S.read(manifest).collect())) == want
    shard = S.Shard(manifest.first().path)
    keys = [S.id_of(k) for k, _ in shard]
    assert shard.get(keys[3])[-1] == 2 and shard.get(10**9) is None
    assert all(shard.bloom.may_have(S.key_of(k)) for k in keys)
    assert sum(shard.bloom.may_have(S.key_of(10**6 + i)) for i in range(2000)) < 100


def test_defined_results(spark):
    docs = spark.createDataFrame([(3, None, 1), (None, "x", 2), (-5, "a b", 3), (3, "z", 4)], "doc_id long, text string, start int")
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in S.read(S.write(docs)).collect())
    assert [x[1] for x in got] == [None, -5, 3, 3] and sum(x[2] for x in got) == 4 + 4
    assert S.read(S.write(docs.limit(0))).count() == 0


def test_several_shards_are_read_in_order(spark):
    # all rows of the null id, a third of the table, are dealt out as well; one text is very long
    rows = [(None, f"text {i} of nobody", 1) for i in range(200)] + [(i, f"text {i} of its own", 2) for i in range(400)] + [(400, "very long " * 60_000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, place int").repartition(7)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = S.write(docs)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    shards = manifest.orderBy("start").collect()
    assert len(shards) > 2 and sum(s.first_id is None for s in shards) > 1
    assert [s.start for s in shards] == [sum(x.n_ids for x in shards[:k]) for k in range(len(shards))]
    got = sorted((r.start, r.n_tokens, r.doc_id is not None, r.doc_id or 0) for r in S.read(manifest).collect())
    assert all(a[0] + a[1] == b[0] for a, b in zip(got, got[1:])) and [x[2:] for x in got] == sorted(x[2:] for x in got)
    own = S.Encoder(S.tokenizer_path())
    assert sum(x[1] for x in got) == sum(len(own.encode([t])[0]) // own.width + 1 for _, t, _ in rows)
    last = S.Shard(shards[-1].path)
    assert len(last.get(400)) == got[-1][1] > 100_000


def test_first_words_are_encoded_once():
    own = S.Encoder(S.tokenizer_path())
    plain, asked, whole = own.tokenizer, [], own.whole
    own.whole = lambda texts: (asked.extend(texts), whole(texts))[1]
    texts = ["The cat", "The dog\nThe", "The", "cat The", "\nThe cat", "The  cat"]
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, f"<u{own.width}").tobytes() for t in texts]
    assert own.encode(texts) == want and asked.count("The") == 1
    asked.clear()
    assert own.encode(texts) == want and sorted(asked) == ["\nThe cat", "The  cat"]
