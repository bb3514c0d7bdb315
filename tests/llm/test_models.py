import math
import zlib
from collections import Counter

import numpy as np

from logloom.llm import lm, toxicity


def test_lm_base_equals_brute_force_and_model_beats_it(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: [*lm.tokens(r.text), b"\0end"] for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    c = Counter(w for i, t in texts.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    out = {r.doc_id: r for r in lm.scores(docs).collect()}
    assert out.keys() == texts.keys()
    for i, t in texts.items():
        want = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        assert out[i].held_out == held[i] and out[i].n_tokens == len(t) and out[i].train_tokens == n
        assert out[i].n_known == sum(c[w] > 0 for w in t) and math.isclose(out[i].base_score, want, rel_tol=1e-9)
    own = [r for r in out.values() if r.held_out]
    assert sum(r.score for r in own) > sum(r.base_score for r in own)


def some_model(n=300, seed=0):
    rng = np.random.default_rng(seed)
    words = lm.Words.of(np.concatenate([[50, 900], np.sort(rng.integers(1, 400, n))[::-1]]) + 0.5)
    model = lm.Model.fresh(words)
    model.flat += rng.normal(0, 0.3, model.flat.shape).astype(np.float32)
    return words, model


def test_lm_groups_cover_all_words():
    for n in (0, 1, 2, 300, 5000):
        words = lm.Words.of(np.arange(n + 2, 0, -1) + 0.5)
        assert words.starts[0] == 0 and words.starts[-1] == n + 2 and (np.diff(words.starts) > 0).all() and len(words.starts) - 1 <= lm.GROUPS
        assert math.isclose(words.masses.sum(), 1) and len(words.group) == n + 2


def slow_log_probability(words, model, b, a, w):
    context, own, of_group, one, two = (x.astype(float) for x in model.parts)
    q = np.append(context[a] @ one + context[b] @ two, 1)
    g = words.group[w]
    within = np.flatnonzero(words.group == g)
    soft = lambda x: x - np.log(np.exp(x).sum())
    return soft(of_group @ q)[g] + soft(own[within] @ q)[w - within[0]]


def test_lm_scores_equal_direct_sums_and_are_normalised(monkeypatch):
    words, model = some_model()
    scorer = lm.Scorer(words, model.flat)
    n = len(words.sizes)
    for b, a in ((0, 0), (5, 9), (299, 1)):
        every = scorer.scores(np.array([(b, a, w) for w in range(n)], np.uint16).T)
        assert math.isclose(np.exp(every).sum(), 1, rel_tol=1e-4)
    ids = np.random.default_rng(3).integers(0, n, 400)
    triples = lm.triples_of(np.append(ids, lm.END))
    want = [slow_log_probability(words, model, *t) for t in triples.T]
    assert np.allclose(scorer.scores(triples), want, atol=1e-4)
    monkeypatch.setattr(lm, "PIECE", 37)
    monkeypatch.setattr(lm, "SCORES", 500)
    assert np.allclose(scorer.scores(triples), want, atol=1e-4)


def test_lm_training_lowers_the_loss_and_averages_by_use():
    words, _ = some_model()
    rng = np.random.default_rng(7)
    text = [np.append(np.tile(rng.integers(2, 40, 3), 20), lm.END) for _ in range(300)]
    trainer = lm.Trainer(words, lm.Model.fresh(words).flat, np.zeros_like(lm.Model.fresh(words).flat), 1)
    before = lm.Scorer(words, trainer.model.flat.copy()).scores(lm.triples_of(text[0])).mean()
    for _ in range(6):
        for ids in text:
            trainer.add(ids)
        trainer.flush()
    assert lm.Scorer(words, trainer.model.flat).scores(lm.triples_of(text[0])).mean() > before + 0.5
    start = lm.Model.fresh(words).flat
    seen = np.zeros_like(trainer.seen)
    seen[:, 5] = 3
    rows = [{"weights": trainer.model.flat.tobytes(), "seen": seen.tobytes()}, {"weights": start.tobytes(), "seen": seen.tobytes()}]
    flat, total = lm.average(rows, words, start)
    parts = [lm.Model(x, len(words.sizes), len(words.starts) - 1).parts[0] for x in (flat, trainer.model.flat, start)]
    assert np.allclose(parts[0][5], (parts[1][5] + parts[2][5]) / 2, atol=1e-6) and np.allclose(parts[0][6], parts[2][6]) and total[0, 5] == 6


def test_lm_does_not_depend_on_partitions(spark, sf, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 8000)  # several blocks, and more than are averaged at once
    monkeypatch.setattr(lm, "FAN", 3)
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(spark.createDataFrame([(None, "a b", None, None, 1), (7, "x " * 3000, None, None, 1)], "doc_id long, text string, lang string, source string, n_chars int"))
    runs = [sorted((r.doc_id is None, r.doc_id, r.n_tokens, r.base_score, r.score) for r in lm.scores(docs.repartition(n)).collect()) for n in (1, 8)]
    for one, other in zip(*runs):
        assert one[:3] == other[:3] and math.isclose(one[3], other[3], rel_tol=1e-9) and math.isclose(one[4], other[4], rel_tol=1e-5)


def test_lm_texts_longer_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 2000)
    rows = [(i, f"some words {i % 7} of text {i}") for i in range(60)] + [(99, "long words of text " * 3000), (99, "long words of text " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    c = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in [*lm.tokens(t), b"\0end"])
    n, v = sum(c.values()), len(c)
    got = lm.scores(docs).collect()
    assert len(got) == len(rows) and len({r.score for r in got if r.doc_id == 99}) == 1
    for r in got:
        words = [*lm.tokens(dict(rows)[r.doc_id]), b"\0end"]
        assert r.n_tokens == len(words) and r.train_tokens == n and math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words), rel_tol=1e-9)


def test_lm_defined_results(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "a b", 6), (1, "a", 7)], "doc_id long, text string, chunk int")
    assert sorted(r.n_tokens for r in lm.scores(docs).collect()) == [1, 2, 3]
    assert lm.scores(docs.limit(0)).count() == 0
    # no training rows: the model is uniform over the end and all others
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    rows = lm.scores(spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.held_out and math.isfinite(r.score) for r in rows) and len({r.score for r in rows}) == 1


def test_nearest_equals_brute_force():
    rng = np.random.default_rng(2)
    n, words = 500, 600
    rows = [np.unique(rng.integers(0, rng.integers(2, words, 1)[0], rng.integers(0, 30))) for _ in range(n)]
    rows[7:11] = [rows[3]] * 4  # ties
    ends = np.cumsum([0, *map(len, rows)])
    ids, counts = np.concatenate(rows).astype(np.int64), rng.integers(1, 4, ends[-1]).astype(float)
    for k in (7, 8, 9, 10):
        counts[ends[k] : ends[k + 1]] = counts[ends[3] : ends[4]]
    doc_ids, toxic = rng.permutation(n) - 100, rng.integers(0, 2, n)
    index = toxicity.Index(ends, ids, counts, doc_ids, toxic, 0.1 + rng.random(words))
    own = index.weighted(ends, ids, counts)
    full = np.zeros((n, words))
    for i in range(n):
        full[i, ids[ends[i] : ends[i + 1]]] = own[ends[i] : ends[i + 1]]
    assert (index.doc_ids[index.place] == doc_ids).all()
    cosines = np.round(full @ full.T, 12)
    for without in (None, index.place):
        for q, (found, near) in enumerate(index.nearest(ends, ids, own, without)):
            want = [i for i in np.lexsort((doc_ids, -cosines[q])) if cosines[q, i] > 0 and (without is None or i != q)][: toxicity.NEAREST]
            assert list(index.doc_ids[found]) == list(doc_ids[want]) and np.allclose(near, cosines[q, want])


def slow_toxicity(docs, labels):
    """Scores and evidence by dense vectors and full sorting; all labelled training rows are examples."""
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    marks = sorted({(r.doc_id, int(r.toxic != 0)) for r in labels if r.toxic is not None and not held(r.doc_id)})
    bags = {i: toxicity.words(t) for i, t in docs}
    marks = [(i, t) for i, t in marks if i in bags]
    names = sorted({w for i, _ in marks for w in bags[i]})
    place = {w: k for k, w in enumerate(names)}
    df = Counter(w for b in bags.values() for w in b)
    toxic = np.array([t for _, t in marks])
    share = [(np.array([sum(w in bags[i] for i, t in marks if t == kind) for w in names]) / (toxic == kind).sum()) + toxicity.SMOOTH for kind in (0, 1)]
    weight = np.log((len(docs) + 1) / np.array([df[w] for w in names])) * np.log2(2 + share[1] / share[0]) ** 2

    def vector(i):
        v = np.zeros(len(names))
        for w, k in bags[i].items():
            if w in place:
                v[place[w]] = (1 + math.log(k)) * weight[place[w]]
        return v / (np.sqrt(v @ v) or 1)

    full = np.array([vector(i) for i, _ in marks])
    ids = np.array([i for i, _ in marks])

    def near(v, without=None):
        cos = np.round(full @ v, 12)
        at = [k for k in np.lexsort((toxic, ids, -cos)) if cos[k] > 0 and k != without][: toxicity.NEAREST]
        if not at:
            return None, []
        w = 1 / (toxicity.HALF + np.maximum(0, 1 - cos[at]))
        return (w * toxic[at]).sum() / w.sum(), ids[at].tolist()

    votes = [near(v, k)[0] for k, v in enumerate(full)]
    known = [k for k, v in enumerate(votes) if v is not None]
    a, b = toxicity.curve(np.array([votes[k] for k in known]), toxic[known].astype(float), np.ones(len(known)))
    out = {}
    for i, _ in docs:
        vote, evidence = near(vector(i))
        out[i] = (toxic.mean() if vote is None else 1 / (1 + math.exp(-(a * toxicity.odds(vote) + b))), evidence)
    return out


def test_toxicity_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    want = slow_toxicity(rows, labels.collect())
    got = {r.doc_id: r for r in toxicity.scores(docs, labels).collect()}
    assert got.keys() == want.keys()
    for i, (score, evidence) in want.items():
        assert math.isclose(got[i].score, score, rel_tol=1e-6, abs_tol=1e-9) and got[i].evidence == evidence
        assert got[i].predicted == (score >= 0.7) and got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_toxicity_held_out_accuracy(spark, sf):
    sf = sf.replace("0.001", "0.1")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    out = toxicity.op5_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").join(docs, "doc_id").where("held_out").collect()
    for lang in {r.lang for r in out}:
        assert np.mean([r.predicted for r in out if r.toxic and r.lang == lang]) >= 0.9
    assert np.mean([r.predicted for r in out if not r.toxic]) < 0.01
    assert all(r.evidence for r in out)


def test_toxicity_defined_results(spark):
    docs = spark.createDataFrame([(1, None, 1), (None, "x", 2), (2, "", 3)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, toxic int")
    assert toxicity.scores(docs, labels).count() == 3
    assert toxicity.scores(docs.limit(0), labels.limit(0)).count() == 0
    # conflicting labels, repeated rows, a very long text, clashing names
    long = "good day to all " * 20_000
    rows = [(0, "bad bad words", 1), (2, "nice words", 1), (3, long, 1), (3, long, 1), (5, "bad", 1), (None, None, 1), (7, "words of bad", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    labels = spark.createDataFrame([(0, 1, 1), (0, 0, 1), (2, 0, 1), (3, 0, 1), (5, 1, 1), (5, 1, 1)], "doc_id long, toxic int, text int")
    got = toxicity.scores(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 3}) == 1
