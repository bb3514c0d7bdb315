import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline as C
from logloom.llm import leaks, quality
from logloom.llm.common import numbered


def test_stages_keep_columns_and_clean_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        assert {r[0] for r in out.select("doc_id").collect()} <= {r[0] for r in docs.select("doc_id").collect()}
        docs = out
    assert 0 < docs.count() < before
    assert C.STAGES[-1][1](spark, docs, sf).where("not round_trip").count() == 0


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return Counter(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else Counter()


def slow_near_dedup(rows):
    """rows(doc_id, text): the rows that stay, by all pairs."""
    sets = [frozenset(shingles(t)) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for i, (doc_id, text) in enumerate(rows):
        groups.setdefault(find(i), []).append((doc_id is None, doc_id or 0, text))
    return sorted(min(g)[:2] for g in groups.values())


def slow_leaks(rows, items):
    """Whether each text has a window of an item's length with weighted similarity 0.8 or more; every window is tried."""
    items = [re.findall(r"[^\x20\x09-\x0D]+", t.lower()) for t in items if t]
    items = [(len(w), shingles(" ".join(w))) for w in items if w]
    out = []
    for text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        own = set(shingles(" ".join(words))) if words else set()
        found = False
        for n, item in items:
            if found or not words or len(words) >= 5 <= n and not own & set(item):  # a window without a shingle of the item is not similar
                continue
            for start in range(max(1, len(words) - n + 1)):
                window = words[start : start + n]
                if len(window) < n and len(window) < len(words):
                    continue
                a = shingles(" ".join(window))
                both = sum((a & item).values())
                if len(window) == n and both >= 0.8 * (a.total() + item.total() - both) - 1e-9:
                    found = True
                    break
        out.append(found)
    return out


def test_stages_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    plain = docs.where("length(text) between 400 and 2000").first()
    extra = [(None, plain.text, "en", "s", 1), (None, plain.text, "en", "s", 1), (None, f"A start. {items[0]} An end.", "en", "s", 1), (3, f"Some words before. {items[1]}", "fr", "s", 1), (3, plain.text + " more", "en", "s", 2), (4, plain.text[::-1], "en", "s", 2), (4, items[2], "en", "t", 2)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    quality.judged(docs).count()
    kept = C.quality_rules(spark, docs, sf)
    want = Counter((r.row.doc_id, r.row.text) for r in quality.judged(docs).where("kept").collect())
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == want
    rows = [(r.doc_id, r.text) for r in docs.where("text is not null").collect()]
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in C.near_dedup(spark, docs.where("text is not null"), sf).collect())
    assert got == slow_near_dedup(rows)
    want = sorted((i is None, i or 0, t) for (i, t), bad in zip(rows, slow_leaks([t for _, t in rows], items)) if not bad)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in C.decontaminate(spark, docs.where("text is not null"), sf).collect())
    assert got == want and len(want) < len(rows)


def test_stages_on_odd_rows(spark, sf):
    text = "Some words that say a thing or two about nothing in particular, and then go on for a while until there are twenty of them."
    other = "Quite another text stands here, which tells of ships and of rivers, of hills and their winds, and of what people made of all of it in time."
    rows = [(1, text, "en", None, 5, "a"), (1, text, "en", None, 5, "b"), (1, text, "en", None, 5, "b"), (1, other, "en", None, 5, "b"), (2, text, None, "s", None, "c"), (None, None, None, None, None, None), (None, text, "en", "s", 1, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string")
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf).count() == 0
        docs = stage(spark, docs, sf)
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == [(1, other), (1, text)]


def test_row_numbers(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = numbered(docs)
    assert rows.select("id").distinct().count() == docs.count() and rows.select("row.*").columns == docs.columns
    one, two = ({r.id: r.doc_id for r in x.select("id", "row.doc_id").collect()} for x in (rows, numbered(docs.select("doc_id"))))
    assert one == two
    odd = spark.createDataFrame([(1, "x"), (1, "x")], "`_metadata` long, `a.b` string")
    assert numbered(odd).select("id").distinct().count() == 2


def test_leaks_equal_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = {(a, b, c, d, round(e, 9)) for a, b, c, d, e in con.execute(leaks.OP9_SQL).fetchall()}
    got = {(r.doc_id, r.item_id, r.first_word, r.n_windows, round(r.similarity, 9)) for r in leaks.op9_decontaminate(spark, sf).collect()}
    assert got == want and want


def test_leaks_find_changed_passages_and_nothing_else(spark):
    item = " ".join(f"w{i}" for i in range(40))
    changed = item.replace("w39", "other")
    rows = [(1, f"x y {item} z"), (2, f"a {changed} b"), (3, "w0 w1 w2 w3 w4 w5 and no more of it"), (None, item), (4, None), (5, " ".join(item.split()[::-1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.first_word) for r in leaks.leaks(docs, items).collect()}
    assert got == {(1, 7, 2), (2, 7, 1), (None, 7, 0)}
    assert leaks.leaks(docs, items.limit(0)).count() == 0 and leaks.leaks(docs.limit(0), items).count() == 0
