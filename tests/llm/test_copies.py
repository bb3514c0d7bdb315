import random

import numpy as np

import corpus_pipeline as C
from logloom.llm import copies as K
from logloom.llm.simhash import syndrome


def plain(text):
    words = (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return not a | b or len(a & b) / len(a | b) >= 0.8


def test_near_copies_equal_all_pairs(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randint(30, 120))]
        for changes in (0, 0, 1, 1, 2, 3, 4):
            own = list(base)
            for _ in range(changes):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(900, ""), (901, None), (902, "two words"), (903, "two words"), (904, "other words")]
    sets = {i: plain(t) for i, t in rows}
    root = {i: i for i, _ in rows}
    for i in sorted(root):  # by hand: spread the least id along the links until nothing changes
        todo = [i]
        while todo:
            a = todo.pop()
            for b in root:
                if root[b] > root[i] and alike(sets[a], sets[b]):
                    root[b] = root[i]
                    todo.append(b)
    docs = spark.createDataFrame(rows, "id long, text string")
    assert {r.id: r.component_id for r in K.near_copies(docs).collect()} == root
    assert 20 < len(set(root.values())) < len(rows)
    assert K.near_copies(docs.limit(0)).count() == 0


def test_stage_drops_a_copy_at_the_limit(spark, sf):
    words = [f"w{i}" for i in range(200)]
    near, far = list(words), list(words)
    for i in (20, 60, 100, 140):
        near[i] = "near"
    for i in range(5, 200, 20):
        far[i] = "far"
    rows = [(i, " ".join(w), "en", "s", 1) for i, w in enumerate((words, near, far))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in C.near_dedup(spark, docs, sf).collect()) == [0, 2]


def test_words_stand_for_the_nearest_codewords():
    rng = np.random.default_rng(2)
    fps = np.array([K.fingerprint(rng.integers(0, 1 << 63, 50, np.uint64)) for _ in range(20)])
    bits = np.unpackbits(fps.view(np.uint8).reshape(20, -1), axis=1, bitorder="little")[:, K.ORDER].reshape(20, K.WORDS, 23)
    data = K.codes(fps) << 11
    assert (np.bitwise_count(data ^ syndrome(data) ^ (bits.astype(np.int64) << np.arange(23)).sum(2)) <= 3).all()


def test_similar_sets_meet_under_codewords():
    rng = np.random.default_rng(4)
    for shared, one, two in ((5, 0, 1), (8, 1, 1), (8, 0, 2), (80, 10, 10), (80, 0, 20), (400, 50, 50)):
        for _ in range(40):
            own = rng.integers(0, 1 << 63, shared + one + two, np.uint64)
            fps = np.array([K.fingerprint(own[: shared + one]), K.fingerprint(np.concatenate([own[:shared], own[shared + one :]]))])
            a, b = K.word_keys(fps)
            apart = np.bitwise_count(fps[0] ^ fps[1])
            assert (a == b).any() and apart[:2].sum() <= K.NEAR and apart.sum() <= K.FAR
    for i in range(5):
        own = np.unique(rng.integers(0, 1 << 63, 5, np.uint64))
        assert K.fours(np.delete(own, i))[0] in K.fours(own)


def test_near_copies_of_eight_and_nine_words(spark):
    words = [f"{w}{i}" for w in "abc" for i in range(9)]
    rows = [(k, " ".join(words[9 * (k // 2) :][: 8 + k % 2])) for k in range(6)]
    got = {r.id: r.component_id for r in K.near_copies(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4}


def test_a_group_writes_its_links_not_its_pairs(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(150):  # any two differ in six places or so: similar by about 0.73
        own = list(base)
        for k in rng.sample(range(6, 194), 3):
            own[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    rows += [(200 + i, rows[i][1] + " end") for i in range(0, 150, 10)]
    sets = {i: plain(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])]
    root = {i: i for i in sets}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    written, whole = [], K.close
    monkeypatch.setattr(K, "close", lambda nodes, pairs: (written.append(pairs.count()), whole(nodes, pairs))[1])
    got = {r.id: r.component_id for r in K.near_copies(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert got == root and len(set(root.values())) > 40
    assert sum(written) < len(rows) * 65 / 2 and written[1] <= 2 * len(rows)  # of 13,530 pairs


def test_short_sets_allow_all_that_are_similar(spark):
    rng = np.random.default_rng(6)
    rows = []
    for shared, one, two in ((8, 1, 1), (80, 10, 10), (800, 100, 100), (800, 0, 200), (90, 5, 5)):
        for _ in range(10):
            own = np.unique(rng.integers(0, 1 << 63, shared + one + two, np.uint64) * np.uint64(2))
            pair = own[: shared + one], np.concatenate([own[:shared], own[shared + one :]])
            rows.append(tuple((len(x), K.short(x).tolist()) for x in pair))
    kinds = "p struct<n: long, own: array<short>>, q struct<n: long, own: array<short>>"
    assert spark.createDataFrame(rows, kinds).where(K._may("p", "q")).count() == len(rows)
    assert not spark.createDataFrame([((100, list(range(100))), (100, list(range(20, 120))))], kinds).where(K._may("p", "q")).count()


def test_nodes_near_a_crowd_leave_as_its_guests(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]

    def changed(words, times, own):
        words = list(words)
        for k in rng.sample(range(6, 194), times):
            words[k] = f"{own}{rng.randrange(10**6)}"
        return " ".join(words)

    rows = [(i, changed(base, 1, "x")) for i in range(100)]  # a crowd
    rows += [(100 + i, " ".join(base[:130] + [f"g{i}x{k}" for k in range(70)])) for i in range(20)]  # alike to it by about a half
    sets = {i: plain(t) for i, t in rows}
    root = {i: i for i in sets}
    for _ in range(3):
        for a in sets:
            for b in sets:
                if a < b and alike(sets[a], sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    written, whole = [], K.close
    monkeypatch.setattr(K, "close", lambda nodes, pairs: (written.append(pairs.count()), whole(nodes, pairs))[1])
    monkeypatch.setattr(K, "CROWD", 20)
    got = {r.id: r.component_id for r in K.near_copies(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert got == root and len(set(root.values())) == 21
    assert sum(written) <= 20 * 19 / 2  # of guests at most, none of the 2,000 with the crowd


def test_blocks_of_a_crowd_and_its_guests_join_what_all_pairs_join(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK_NODES", 8)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[:5] + [f"x{j}" for j in range(i)] + base[5 + i :])) for i in range(30)]  # each is like the next ones
    docs = spark.createDataFrame(rows, "id long, text string")
    sets = {i: plain(t) for i, t in rows}
    for guests in (False, True):
        crowd = spark.createDataFrame([(i, len(sets[i]), 0, guests and i % 2 == 0) for i in sets], "node long, n long, crowd long, guest boolean")
        links = [(r.a, r.b) for r in K.crowd_links(docs, crowd, guests).collect()]
        assert all(a < b and alike(sets[a], sets[b]) and (not guests or (a + b) % 2) for a, b in links)
        assert {r.component for r in K.components(K.crowd_links(docs, crowd, guests)).collect()} == {0}
        assert len(links) < 30 * 4


def test_packed_rows_give_all_pairs_that_share_a_decoding():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 60, np.uint64)
    fps = np.array([K.fingerprint(np.concatenate([base[: 60 - k % 9], rng.integers(0, 1 << 63, k % 9, np.uint64)])) for k in range(40)])
    node, code = np.arange(40) + (5 << 40), K.codes(fps)[:, 0] % 8  # few, so that many meet
    crowd, n, big = np.where(node % 4 == 0, node[0], node), np.full(40, 60), node % 4 == 0
    fixed = np.column_stack([fps[:, :2].view(np.int64), node, crowd ^ node, n << 1 | big]).view(np.uint8)
    table = np.column_stack([fixed, code.astype(np.uint16)[:, None].view(np.uint8)])
    got = K.meeting([table[:17].T.tobytes(), table[17:].T.tobytes()])
    want = set()
    for p in range(40):
        for q in range(p + 1, 40):
            if code[p] == code[q] and crowd[p] != crowd[q] and np.bitwise_count(fps[p, :2] ^ fps[q, :2]).sum() <= K.NEAR:
                one, two = (q, p) if big[p] else (p, q)
                want.add((int(node[one]), int(crowd[two] if big[two] else node[two]), bool(big[two])))
    assert set(zip(*(got[c].tolist() for c in ("a", "b", "big")), strict=True)) == want and len(want) > 20
