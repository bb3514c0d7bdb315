"""Near copies for the pipeline: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more, found by the
method of operator 3 (SimHash fingerprints that meet under Golay codewords, links verified, components) at a wider radius.

Such texts have about 0.15 of the bits of their fingerprints different, which no four of 64 bits cover. So fingerprints are
longer and meet under more words:

1. Fingerprints. Texts with equal sets of shingles are one node. Its fingerprint has BITS majority votes over the hashes of
   its shingles. WORDS words of 23 bits are read from it, each bit in two or three of them, and each word stands for its
   decoding, the one codeword of the Golay code within 3 bits. Two texts at exactly 0.8 share the decoding of a word with
   probability 0.121. Of 960,000 simulated pairs none shared fewer than two of all WORDS, one shared two and six three; as
   the numbers fall, about 1 in 30 million shares none. Closer pairs share more. In texts of eight and nine words (four of
   five shingles) ties are frequent, so sets of five also stand under each four of their shingles, which is exact. Smaller
   sets are similar only if they are equal.
2. Crowds. Nodes that share two decodings at once are compared with the least and the greatest node that do. Those with NEAR
   or fewer of 128 bits different are joined, in chains too, into crowds. Most of a crowd may be no copies.
3. Links in crowds. All pairs of a crowd are compared, by fingerprints and then by their sets of shingles. Crowds are dealt in
   blocks, so that each two blocks meet in one task; it writes a forest of the links that it finds, never more than its nodes.
4. Links between crowds. Nodes of different crowds (or of none) that share a decoding are pairs if NEAR or fewer of 128 bits
   differ. Nodes of a batch travel as one packed row a word, and a task compares those of its bucket; nodes of one crowd are
   passed over at once. Pairs within FAR bits of the whole fingerprint are linked if the similarity of their shingle sets, from
   the texts, is 0.8 or more. A node that is near any of a crowd of CROWD or more becomes a guest of it, one row however many
   it is near to; guests are compared with all of the crowd as in step 3. Links become components.

Two that are no copies share a decoding of a word with probability 1/4096, and a task looks at their 128 bits; this part
grows with the square of the number of nodes. Comparing a crowd costs time with the square of its size; what is written of it
grows with its size, and what is dealt also with the number of its blocks.

Defined results: words are as in operator 3 (ASCII case and blanks); a text of fewer than five words has one shingle, the
whole; null texts are empty; texts without words are equal; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import few, slices, small_batches, stored
from .graph import components
from .simhash import golay, syndrome

SHINGLE, LONGS, WORD = 5, 23, 23
BITS, WORDS = 64 * LONGS, 160
#: Keys of two words.
JOINT = 32
#: Bits that may differ: of the first 128, and of all. At 0.8 they are 0.1515 of them; by the binomial law more differ in 1 pair
#: of some 10^7.
NEAR, FAR = 44, 304
#: Nodes of a crowd that has guests, at least.
CROWD = 64
#: Nodes and shingles of a block of a crowd, about.
BLOCK_NODES, BLOCK_SHINGLES = 2048, 1 << 20
#: Nodes whose keys of a word are compared in one task, about, and the bytes of a packed one.
BUCKET, PACKED = 250_000, 42
#: Shingles whose votes are counted at once: a lane of eight bits holds so many.
BLOCK = 255
_rng = np.random.default_rng(5)
_odd = _rng.integers(0, 1 << 63, SHINGLE + LONGS, np.uint64) * np.uint64(2) + np.uint64(1)
PLACES, FACTORS = np.split(_odd, [SHINGLE])
#: What a bit is when the votes are equal, and the bits of each word.
TIES = _rng.integers(0, 2, BITS)
ORDER = np.concatenate([_rng.permutation(BITS) for _ in range(3)])[: WORDS * WORD]
LANES = np.uint64(0x0101010101010101)
SHIFTS = np.arange(8, dtype=np.uint64)[:, None, None]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingles(text: str) -> np.ndarray:
    """The distinct shingles' hashes, in order."""
    words = text.encode("utf-8", "replace").lower().split()
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))] if words else [], np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    return np.unique(_mixed(sum(own[j : j + n] * PLACES[j] for j in range(SHINGLE))))


def fingerprint(own: np.ndarray) -> np.ndarray:
    """The fingerprint of a set of shingles: LONGS numbers of 64 bits."""
    votes = np.zeros((8, LONGS, 8), np.int64)  # by bit of a byte, number, byte
    for start in range(0, len(own), BLOCK):
        hashes = _mixed(own[start : start + BLOCK, None] * FACTORS)
        votes += (hashes >> SHIFTS & LANES).sum(1, dtype=np.uint64).view(np.uint8).reshape(votes.shape)
    votes = votes.transpose(1, 2, 0).reshape(-1)
    return np.packbits(2 * votes + TIES > len(own), bitorder="little").view(np.uint64)


def codes(fps: np.ndarray) -> np.ndarray:
    """The decodings of the words of each fingerprint, as the 12 bits that tell a codeword."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")
    packed = np.packbits(bits[:, ORDER].reshape(len(fps), WORDS, WORD), axis=2, bitorder="little").astype(np.int64)
    words = packed[..., 0] | packed[..., 1] << 8 | packed[..., 2] << 16
    return (words ^ golay()[0][syndrome(words)]) >> 11


def word_keys(fps: np.ndarray) -> np.ndarray:
    """A key for each word."""
    return np.arange(WORDS) << 12 | codes(fps)


def joint_keys(fps: np.ndarray) -> np.ndarray:
    """Keys of two words each."""
    own = codes(fps)[:, : 2 * JOINT]
    return np.arange(JOINT) << 24 | own[:, ::2] << 12 | own[:, 1::2]


def fours(own: np.ndarray) -> np.ndarray:
    """Of a set of four shingles its hash, of a set of five those of its sets of four; of others none."""
    sets = [own] if len(own) == SHINGLE - 1 else [np.delete(own, i) for i in range(SHINGLE)] if len(own) == SHINGLE else []
    return np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    whole = np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(whole))


def sketches(docs: DataFrame) -> DataFrame:
    """id, digest (of the set of shingles), n (its size), fp, fours."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            digests = [xxhash.xxh128_digest(s.tobytes()) for s in sets]
            columns = [batch.column("id"), pa.array(digests, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), _lists([fingerprint(s) for s in sets]), _lists([fours(s) for s in sets])]
            yield pa.RecordBatch.from_arrays(columns, ["id", "digest", "n", "fp", "fours"])

    return docs.mapInArrow(run, "id long, digest binary, n long, fp array<long>, fours array<long>")


def keyed(nodes: DataFrame) -> DataFrame:
    """nodes(node, n, fp): node, x and y (the first 128 bits) for each key of two words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = _prints(batch)
            x, y = (pa.array(np.ascontiguousarray(fps[:, i]).view(np.int64)) for i in range(2))
            yield pa.RecordBatch.from_arrays([batch.column("node"), x, y, _lists(list(joint_keys(fps).view(np.uint64)))], ["node", "x", "y", "keys"])

    rows = nodes.where(f"n >= {SHINGLE}").select("node", "fp").mapInArrow(run, "node long, x long, y long, keys array<long>")
    return rows.select("node", "x", "y", F.explode("keys").alias("key"))


def _prints(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    fps = rows.column("fp")
    fps = fps.combine_chunks() if isinstance(fps, pa.ChunkedArray) else fps
    return fps.flatten().to_numpy().view(np.uint64).reshape(-1, LONGS)


def packed(nodes: DataFrame, splits: int) -> DataFrame:
    """nodes(node, n, crowd, big, fp): bucket (a word, and the remainder of its decoding by splits), rows: the nodes of a batch
    that stand in it, PACKED bytes each, the first bytes of all before the second ones, which compresses well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.sort_by("node")
            fps = _prints(batch)
            node, crowd, n, big = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "crowd", "n", "big"))
            fixed = np.column_stack([fps[:, :2].view(np.int64), node, crowd ^ node, n << 1 | big]).view(np.uint8)
            keys = word_keys(fps).ravel()
            code = (keys & 4095).astype(np.uint16)
            bucket = (keys >> 12) * splits + code % splits
            order = np.argsort(bucket, kind="stable")
            first = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            buckets, rows = bucket[order[first]], []
            for at in np.split(order, first[1:]):
                rows.append(np.column_stack([fixed[at // WORDS], code[at, None].view(np.uint8)]).T.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(rows, pa.binary())], ["bucket", "rows"])

    return nodes.where(f"n >= {SHINGLE}").select("node", "n", "crowd", "big", "fp").mapInArrow(run, "bucket long, rows binary")


def meeting(rows: list[bytes]) -> dict[str, np.ndarray]:
    """Of the packed rows of a bucket, those that share a decoding, are near and of different crowds: a and b (a < b), two nodes;
    where big, a guest and its crowd, which of two large ones is the greater."""
    table = np.concatenate([np.frombuffer(r, np.uint8).reshape(PACKED, -1).T for r in rows])
    code = np.ascontiguousarray(table[:, 40:]).view(np.uint16)[:, 0]
    longs = np.ascontiguousarray(table[:, :40]).view(np.int64)
    order = np.lexsort((longs[:, 3] ^ longs[:, 2], code))
    code, (x, y, node, crowd, n) = code[order], np.ascontiguousarray(longs[order].T)
    crowd, x, y, n, big = crowd ^ node, x.view(np.uint64), y.view(np.uint64), n >> 1, (n & 1).astype(bool)
    first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (crowd[1:] != crowd[:-1])]))
    # each node meets those of its decoding that stand after its crowd
    i, j = np.arange(len(code)), np.repeat(np.append(first[1:], len(code)), np.diff(first, append=len(code)))
    end = np.searchsorted(code, code, side="right")
    found = [np.zeros((2, 0), np.int64)]
    while True:
        if not (on := j < end).all():
            i, j, end = i[on], j[on], end[on]
        if not len(i):
            break
        near = np.flatnonzero(np.bitwise_count(x[i] ^ x[j]) + np.bitwise_count(y[i] ^ y[j]) <= NEAR)
        if len(near):
            p, q = i[near], j[near]
            found.append(np.stack([p, q])[:, 5 * np.minimum(n[p], n[q]) >= 4 * np.maximum(n[p], n[q])])
        j = j + 1
    p, q = np.concatenate(found, axis=1)
    swap = big[p] & (~big[q] | (crowd[p] > crowd[q]))
    p, q = np.where(swap, q, p), np.where(swap, p, q)
    one, two = node[p], np.where(big[q], crowd[q], node[q])
    found = np.stack([np.where(big[q], one, np.minimum(one, two)), np.where(big[q], two, np.maximum(one, two)), big[q]])
    a, b, large = np.unique(found, axis=1)
    return {"a": a, "b": b, "big": large.astype(bool)}


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, own: the shingles of the documents with these ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("id"), _lists([shingles(t) for t in batch.column("text").to_pylist()])], ["id", "own"])

    return stored(docs.join(few(ids.distinct(), "ids"), "id", "left_semi").mapInArrow(run, "id long, own array<long>"), "sets")


def crowd_links(docs: DataFrame, crowds: DataFrame, guests: bool = False) -> DataFrame:
    """crowds(node, n, crowd, guest): a, b: links between the nodes of each crowd, with guests only those between a guest and
    none; enough to join all that links join."""
    sizes = crowds.groupBy("crowd").agg(F.expr(f"cast(ceil(greatest(count(1) / {BLOCK_NODES}, sum(n) / {BLOCK_SHINGLES})) as long)").alias("blocks"))
    own = few(crowds.join(sizes, "crowd").select(F.col("node").alias("id"), "crowd", "blocks", "guest"), "crowds")
    # crowds of one block are dealt many to a task
    of, size = crowds.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    buckets = max(1, of // BLOCK_NODES, size // BLOCK_SHINGLES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "crowd", "blocks", "guest")), _lists([fingerprint(s) for s in sets]), _lists(sets)], ["node", "crowd", "blocks", "guest", "fp", "own"])

    def links(table: pa.Table) -> pa.Table:
        table = table.sort_by("crowd").combine_chunks()
        crowd = table.column("crowd").to_numpy()
        first = np.flatnonzero(np.concatenate([[True], crowd[1:] != crowd[:-1]]))
        out = []
        for at, n in zip(first.tolist(), np.diff(first, append=len(crowd)).tolist(), strict=True):
            rows = table.slice(at, n)
            node, block, guest = (rows.column(c).to_numpy() for c in ("node", "block", "guest"))
            sides = [block] * (rows.column("i")[0] != rows.column("j")[0]) + [guest] * guests
            sets = [s.values.to_numpy().view(np.uint64) for s in rows.column("own")]
            out += [(min(p), max(p)) for p in node[forest(_prints(rows), sets, *sides)].tolist()]
        return pa.table({c: pa.array([p[k] for p in out], pa.int64()) for k, c in enumerate("ab")})

    rows = docs.join(own, "id").select("id", "text", "crowd", "blocks", "guest").mapInArrow(run, "node long, crowd long, blocks long, guest boolean, fp array<long>, own array<long>")
    rows = rows.withColumn("block", F.expr("pmod(xxhash64(node), blocks)")).withColumn("with", F.explode(F.expr("sequence(0L, blocks - 1)")))
    rows = rows.withColumn("i", F.least("block", "with")).withColumn("j", F.greatest("block", "with"))
    rows = rows.withColumn("bucket", F.expr(f"if(blocks > 1, crowd, -1 - pmod(xxhash64(crowd), {buckets}))"))
    return rows.select("bucket", "i", "j", "crowd", "node", "block", "guest", "fp", "own").groupBy("bucket", "i", "j").applyInArrow(links, "a long, b long")


def forest(fps: np.ndarray, sets: list[np.ndarray], *sides: np.ndarray) -> np.ndarray:
    """Of the links between sets that differ in all sides, as many as join what they all join: pairs of places."""
    sizes, label = np.array([len(s) for s in sets]), np.arange(len(sets))
    at = np.concatenate([[0], np.cumsum(sizes)])
    names, own = np.unique(np.concatenate(sets), return_inverse=True)
    mark, out = np.zeros(len(names), np.int64), []
    for a in range(len(sets) - 1):
        b = np.arange(a + 1, len(sets))
        b = b[np.all([label[b] != label[a], *(s[b] != s[a] for s in sides)], axis=0)]
        b = b[5 * np.minimum(sizes[b], sizes[a]) >= 4 * np.maximum(sizes[b], sizes[a])]
        b = b[np.bitwise_count(fps[b, :2] ^ fps[a, :2]).sum(1) <= NEAR]
        b = b[np.bitwise_count(fps[b] ^ fps[a]).sum(1, dtype=np.int64) <= FAR]
        if not len(b):
            continue
        mark[own[at[a] : at[a + 1]]] = 1
        shared = np.add.reduceat(mark[np.concatenate([own[at[c] : at[c + 1]] for c in b.tolist()])], np.cumsum(sizes[b]) - sizes[b])
        mark[own[at[a] : at[a + 1]]] = 0
        for c in b[9 * shared >= 4 * (sizes[a] + sizes[b])].tolist():
            if label[c] != label[a]:
                label[label == label[c]] = label[a]
                out.append((a, c))
    return np.array(out, np.int64).reshape(-1, 2)


def short(own: np.ndarray) -> np.ndarray:
    """The shingles' first 16 bits, each once."""
    return np.unique(own >> np.uint64(48)).astype(np.uint16).view(np.int16)


def _may(p: str, q: str) -> str:
    """SQL: whether the sets can be similar by their short forms. What clashes within one of them may be shared too."""
    clash = f"least({p}.n - size({p}.own), {q}.n - size({q}.own))"
    return f"9 * (size(array_intersect({p}.own, {q}.own)) + {clash}) >= 4 * ({p}.n + {q}.n)"


def _similar(x: str, y: str) -> str:
    """SQL: whether two sets of shingles are similar. Four fifths of the union are four ninths of both sizes."""
    return f"9 * size(array_intersect({x}, {y})) >= 4 * (size({x}) + size({y}))"


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(a, b): those whose texts are similar."""
    sets = sets_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")))
    pairs = few(pairs, "pairs")  # far smaller than the sets
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("own").alias("y")), "b")
    return stored(both.where(_similar("x", "y")).select("a", "b").distinct(), "links")


def close(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(a, b): those whose sizes and fingerprints allow the similarity."""
    one, two = (nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("fp").alias(f"fp_{c}")) for c in "ab")
    apart = f"aggregate(zip_with(fp_a, fp_b, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x) <= {FAR}"
    return stored(pairs.join(one, "a").join(two, "b").where(f"{_alike('n_a', 'n_b')} and (n_a + n_b < {2 * SHINGLE} or {apart})").select("a", "b"), "close")


def _alike(m: str, n: str) -> str:
    """SQL: whether sets of such sizes can be similar."""
    return f"5 * least({m}, {n}) >= 4 * greatest({m}, {n})"


def led(nodes: DataFrame) -> DataFrame:
    """a, b: nodes and the leads of their keys of two words, where near by their first 128 bits."""
    by_key = Window.partitionBy("key")  # the keys are made and dealt once
    rows = keyed(nodes).select("key", F.struct("node", "x", "y").alias("own"))
    rows = rows.withColumn("lo", F.min("own").over(by_key)).withColumn("hi", F.max("own").over(by_key)).where("lo.node < hi.node")
    near = f"own.node <> lead.node and bit_count(own.x ^ lead.x) + bit_count(own.y ^ lead.y) <= {NEAR}"
    pairs = rows.select("own", F.explode(F.array("lo", "hi")).alias("lead")).where(near)
    return pairs.select(F.least("own.node", "lead.node").alias("a"), F.greatest("own.node", "lead.node").alias("b")).distinct()


def met(nodes: DataFrame) -> DataFrame:
    """nodes(node, n, crowd, big, fp): a, b, big: nodes of different crowds that share a key of a word and are near by their first
    128 bits (a < b); if big, a node that so meets one of a large crowd, and the crowd."""
    splits = min(4096, -(-nodes.count() // BUCKET) or 1)

    def run(table: pa.Table) -> pa.Table:
        return pa.table(meeting(table.column("rows").to_pylist()))

    return packed(nodes, splits).groupBy("bucket").applyInArrow(run, "a long, b long, big boolean").distinct()


def shortest(nodes: DataFrame) -> DataFrame:
    """a, b (a < b): nodes of four shingles and those of five that hold them."""
    rows = nodes.select("node", "n", F.explode("fours").alias("key"))
    four, five = (rows.where(f"n = {n}").select("key", F.col("node").alias(c)) for n, c in ((SHINGLE - 1, "p"), (SHINGLE, "q")))
    return four.join(five, "key").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def near_copies(docs: DataFrame) -> DataFrame:
    """docs(id, text), ids without nulls or repeats: id, component_id (smallest id in reach), for every id."""
    docs = docs.select("id", F.coalesce("text", F.lit("")).alias("text"))
    prints = stored(sketches(docs), "sketches")
    least = stored(prints.groupBy("digest").agg(F.min("id").alias("node")), "nodes")
    members = prints.select("id", "digest").join(least, "digest").select("id", "node")
    firsts = prints.where(f"n >= {SHINGLE - 1}").join(least.select("digest", F.col("node").alias("id")), ["digest", "id"], "left_semi")
    nodes = stored(firsts.select(F.col("id").alias("node"), "n", "fp", "fours"), "firsts")
    crowds = stored(components(stored(led(nodes), "led")).withColumnRenamed("component", "crowd"), "crowds")
    sizes = crowds.groupBy("crowd").agg((F.count(F.lit(1)) >= CROWD).alias("big"))
    nodes = nodes.join(few(crowds.join(sizes, "crowd"), "crowd"), "node", "left").withColumn("alone", F.col("crowd").isNull())
    nodes = stored(nodes.withColumns({"crowd": F.coalesce("crowd", "node"), "big": F.coalesce("big", F.lit(False))}), "placed")
    own = nodes.where("not alone").select("node", "n", "crowd", "big", F.lit(False).alias("guest"))
    links = stored(crowd_links(docs, own), "forest")
    pairs = stored(met(nodes), "met")
    guests = pairs.where("big").select(F.col("a").alias("node"), F.col("b").alias("crowd"))
    hosts = few(guests.select("crowd").distinct(), "hosts")
    guests = guests.join(nodes.select("node", "n"), "node").select("node", "n", "crowd", F.lit(True).alias("guest"))
    visits = stored(own.where("big").join(hosts, "crowd", "left_semi").select("node", "n", "crowd", "guest").unionByName(guests), "guests")
    links = links.unionByName(stored(crowd_links(docs, visits, guests=True), "visits"))
    pairs = close(nodes, pairs.where("not big").select("a", "b"))
    pairs = pairs.unionByName(close(nodes.where(f"n <= {SHINGLE}"), stored(shortest(nodes), "shortest")))
    rooted = components(links.unionByName(verified(docs, pairs))).select("node", F.col("component").alias("root"))
    return members.join(rooted, "node", "left").select("id", F.coalesce("root", "node").alias("component_id"))
