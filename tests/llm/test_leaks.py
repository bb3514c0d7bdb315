import random
from collections import Counter

from pyspark.sql import functions as F

from logloom.llm import leaks as L


def shingles(words):
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(docs, items):
    """The pairs of a document and an item of which any window at all leaks."""
    out = set()
    for d, text in docs:
        words = text.split()
        for i, item in items:
            own = item.split()
            want = shingles(own)
            for start in range(max(1, len(words) - len(own) + 1)):
                have = shingles(words[start : start + len(own)])
                if sum((have & want).values()) >= 0.8 * sum((have | want).values()):
                    out.add((d, i))
                    break
    return out


def test_pairs_equal_every_window(spark, monkeypatch):
    rng = random.Random(7)
    items, docs = [], []
    for i, n in enumerate((3, 5, 6, 12, 40, 60, 60, 100)):
        items.append((i, " ".join(rng.choice("abcdefgh") * 2 + str(rng.randrange(40)) for _ in range(n))))
    for i, item in items:
        own = item.split()
        for cut in (0, len(own) // 2, len(own) // 3, 2):
            for spoilt in (0, 1, 2):
                moved = own[cut:] + own[:cut]
                for _ in range(spoilt):
                    moved[rng.randrange(len(moved))] = "other"
                gap = ["between"] * rng.randrange(3) if spoilt else []
                docs.append((len(docs), " ".join([*["before"] * rng.randrange(9), *moved[:cut], *gap, *moved[cut:], *["after"] * rng.randrange(9)])))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id) for r in L.leaks(*frames).collect()} == want
    monkeypatch.setattr(L, "INLINE", 0)
    assert {(r.doc_id, r.item_id) for r in L.leaks(*frames).collect()} == want
    monkeypatch.setattr(L, "BROADCAST", 0)
    assert {(r.doc_id, r.item_id) for r in L.leaks(*frames).collect()} == want


def test_swapped_halves_leak(spark):
    own = [f"w{i}" for i in range(60)]
    text = " ".join(["before"] * 50 + own[30:] + own[:30] + ["after"] * 50)
    found = L.leaks(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(7, " ".join(own))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, round(r.similarity, 3)) for r in found] == [(1, 7, 0.867)]


def test_fingerprints_are_majorities(spark):
    rng = random.Random(1)
    rows = [(i, [str(rng.randrange(50)) for _ in range(rng.randint(1, 300))]) for i in range(40)]
    df = spark.createDataFrame(rows, "i int, x array<string>")
    own = df.select("i", L._fingerprint("x").alias("fp"), *(F.expr(f"transform(x, v -> xxhash64({k}, v))").alias(f"h{k}") for k in range(L.PARTS))).collect()
    for r in own:
        for k, fp in enumerate(r.fp):
            h = r[f"h{k}"]
            assert fp == sum(1 << b for b in range(63) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_all_within_the_radius_meet_and_few_others(spark):
    rng = random.Random(2)
    flip = lambda fp, bits: [x ^ sum(1 << b % 63 for b in bits if b // 63 == p) for p, x in enumerate(fp)]
    new = lambda: [rng.getrandbits(63) for _ in range(L.PARTS)]
    items = [(50, new()) for _ in range(20)]
    windows, want = [(50, new()) for _ in range(200)], set()
    for n, fp in items:
        for k in (0, 1, 20, 40, L.RADIUS, L.RADIUS + 1):
            other = flip(fp, rng.sample(range(63 * L.PARTS), k))
            windows.append((n, other))
            if k <= L.RADIUS:
                want.add((tuple(other), tuple(fp)))
    frame = lambda rows: spark.createDataFrame(rows, "n_words int, fp array<long>")
    assert {(tuple(r.fp), tuple(r.item_fp)) for r in L.near(frame(windows), frame(items)).collect()} == want


def test_odd_rows(spark):
    item = " ".join(f"w{i}" for i in range(30))
    long = " ".join(f"v{i}" for i in range(20_000))
    docs = spark.createDataFrame([(1, f"a {item} b", 1), (1, f"a {item} b", 1), (2, f"{long} {item} {long}", 2), (3, long, 3), (None, None, 4)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(9, item, 1), (8, item, 1), (7, None, 1), (6, " ", 1)], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id, r.first_word) for r in L.leaks(docs, items).collect()}
    assert got == {(1, 8, 1), (1, 9, 1), (2, 8, 20_000), (2, 9, 20_000)}
