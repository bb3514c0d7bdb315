import random

import numpy as np
import xxhash

from logloom.llm import graph
from logloom.llm import simhash as S


def brute_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(prints):
    """doc_id -> component by all pairs."""
    ids, parent = list(prints), {i: i for i in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    fps = np.array([prints[i] for i in ids], np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[k]) <= 4):
            a, b = find(i), find(ids[j])
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_equals_brute_force(spark, sf):
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    prints = {r.doc_id: brute_print(r.text) for r in docs.collect()}
    want = brute_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_duplicates(docs).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def test_every_link_is_found(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1}
    for f in list(fps):
        for _ in range(4):
            fps.add(f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    signed = [f - (1 << 64 if f >> 63 else 0) for f in fps]
    got = {(r.a, r.b) for r in S.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 4}
    assert got == want and want


def test_keys_are_not_broadcast(spark):
    found = S.links(spark.createDataFrame([(i,) for i in range(64)], "fp long"))
    assert found.count() > 0 and found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_codewords_near_neighbours():
    nearest, counts, _ = S.golay()
    assert {int(c) for c in counts} == {1, 6} and int(np.bitwise_count(nearest.astype(np.uint64)).max()) == 3


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(50)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_defined_results(spark):
    rows = [(5, None), (3, ""), (9, "same words here now ok"), (None, "same words here now ok"), (9, "same words here now ok"), (7, "y " * 100000)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, fp string")
    got = [(r.doc_id, r.component_id) for r in S.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted([(5, 3), (3, 3), (9, 9), (None, 9), (9, 9), (7, 7)], key=str)
    assert S.near_duplicates(docs.limit(0)).count() == 0
