import re
from collections import Counter

import numpy as np

from logloom.llm import quality as Q


def brute(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_counts_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    out = Q.op7_quality_rules(spark, sf).collect()
    assert {r.doc_id: (*(r[c] for c in Q.COUNTS), r.base_failed) for r in out} == want
    assert not any(r.kept and r.base_failed for r in out)


def test_small_texts():
    for text in ["", None, "a " * 9, "a b c d e f g h " * 2, "x\n\n x\nx\n", "a b c d e f g h i j a b c d e f g h"]:
        m = Q.measure(text)
        assert (*(m[c] for c in Q.COUNTS), m["base_failed"]) == brute(text)


def test_verdict_leaves_clean_rows_and_takes_outliers(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(3000)]
    make = lambda n: " ".join(rng.choice(words, n)).capitalize() + "."
    rows = [(i, " ".join(make(12) for _ in range(8)), "en", "a" if i % 3 else None) for i in range(900)]
    bad = [(1000 + i, " ".join(f"{w}$$##" for w in make(60).split()), "en", "a") for i in range(60)]
    out = {r.row.doc_id: r.kept for r in Q.judged(spark.createDataFrame(rows + bad, "doc_id long, text string, lang string, source string")).collect()}
    assert all(out[r[0]] for r in rows) and not any(out[r[0]] for r in bad)


def cells_of(rows, grid):
    """The rows' cells, or a cell for each row."""
    key = np.floor(rows / Q.STEP).astype(int) if grid else np.arange(len(rows))[:, None]
    _, at = np.unique(key, axis=0, return_inverse=True)
    products = np.column_stack([rows[:, i] * rows[:, j] for i in range(5) for j in range(i + 1)])
    add = lambda x: np.column_stack([np.bincount(at.ravel(), c) for c in x.T])
    return Q.Cells(np.bincount(at.ravel()), add(rows), add(products))


def test_estimates_on_cells_agree_with_estimates_on_rows():
    for seed in range(6):
        rng = np.random.default_rng(seed)
        spread = rng.normal(0, 0.12, (5, 5)) + np.diag([0.15, 0.1, 0.1, 0.15, 0.2])
        clean = rng.normal(0, 1, (1500, 5)) @ spread + rng.uniform(0.4, 1.5, 5)
        bad = rng.normal(0, 0.1, (300, 5)) + clean.mean(0) + rng.choice([-3, 3], 5) * np.abs(spread).sum(0)
        rows = np.concatenate([clean, bad])
        verdicts = []
        for grid in (True, False):
            mean, cov = Q.determinant_estimate(cells_of(rows, grid))
            verdicts.append(Q._distances(rows, mean, cov) <= Q.CUT)
            assert np.abs(mean - clean.mean(0)).max() < 0.1
        assert (verdicts[0] != verdicts[1]).mean() < 0.005
        assert verdicts[0][:1500].mean() > 0.99 and verdicts[0][1500:].mean() < 0.05


def test_odd_rows(spark):
    text = "The quick words of a plain text that goes on for a good while, until there are more than twenty of them in it."
    long = " ".join(f"{w}{i}" for i in range(6000) for w in ("some", "words", "of"))
    docs = spark.createDataFrame([(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, long, "en", "s", 2), (None, text, None, None, 3)], "doc_id long, text string, lang string, source string, mean int")
    rows = Q.judged(docs).collect()
    assert len(rows) == 4 and all(r.kept for r in rows) and sorted(r.row["mean"] for r in rows) == [1, 1, 2, 3]
    assert [r.m.n_words for r in rows if r.row.doc_id == 2] == [18000]


def test_defined_results(spark):
    docs = spark.createDataFrame([(1, None, None, None, "m"), (None, "w " * 50, "en", "s", None)], "doc_id long, text string, lang string, source string, m string")
    out = Q.judged(docs).select("row.doc_id", "row.m", "kept").collect()
    assert len(out) == 2 and not any(r.kept for r in out)
    assert Q.judged(docs.limit(0)).count() == 0
