"""Operator 5: toxicity by the nearest labelled examples in exact TF-IDF cosine.

1. Examples are labelled training rows, at most EXAMPLES a class (a parameter), in the order of a hash of doc_id. Their ids
   are broadcast, so no text is shuffled. Their words are the vocabulary; none is left out.
2. Every document becomes a sparse vector over it: (1 + log(count)) times the inverse document frequency over all documents
   times the square of the word's relevance frequency, log2(2 + share of the toxic examples that have the word over
   that of the others, each with SMOOTH on top). Plain TF-IDF finds texts on like subjects, whose toxicity is another
   matter: at sf0.1 it catches at most half of the held-out toxic rows without false alarms.
3. The examples stand in an index in blocks of BLOCK. The COMMON words with the longest postings have, for each block, the
   largest weight in it; all others have postings. A query's products over the postings are summed exactly, so a block's
   best is bounded by its best sum and the block's largest weights of the common words. Only blocks whose bound reaches the
   NEAREST-th best so far are looked into; the result is exact.
4. The neighbours vote with weights that fall with distance, each class by its rows for an example; a logistic curve, fitted to
   the votes that examples get from each other, turns the vote into a score. A document without a known word gets the
   share of toxic rows.

Labels come from rows with crc32(doc_id) mod 3 other than 1 only. lang, source and doc_id are no inputs of a score.

Defined results: a null or empty text has no word; a null doc_id is held out as the text "null" would be and is no
example; conflicting labels of a doc_id count each, equal ones once; ties between neighbours go to the smaller doc_id, then to
the example that is not toxic; very long texts are read whole; without training rows of both classes every score is the share of
toxic rows (0 without any); empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, small_batches, stored, table, texts

#: Labelled training rows of a class that are examples, at most; neighbours that vote; examples of a block.
EXAMPLES, NEAREST, BLOCK = 2000, 7, 64
#: Words whose weights are bounded by block.
COMMON = 256
SMOOTH = 0.003
THRESHOLD = 0.7
WORD = re.compile(r"\w+")
#: Distance at which a neighbour's weight is half that of one without any.
HALF = 0.05
#: Documents that are looked up together, and documents of a task.
BATCH, DEALT = 256, 4000


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null"))) % 3 == 1


def words(text: str) -> Counter:
    return Counter(WORD.findall(text.lower()))


def sampled(marks: DataFrame) -> tuple[DataFrame, int, int]:
    """marks(doc_id, toxic), distinct. The examples' ids, and how many rows are toxic and not."""
    rows = {bool(r.toxic): r["count"] for r in marks.groupBy("toxic").count().collect()}
    n1, n0 = rows.get(True, 0), rows.get(False, 0)
    place, out = F.xxhash64("doc_id"), None
    for toxic, n in ((1, n1), (0, n0)):
        # the hashes' lower end holds EXAMPLES rows and a few more, so that few rows meet in the cut
        end = int((1 << 64) * min(1.0, (EXAMPLES + 10 * EXAMPLES**0.5) / max(n, 1))) - (1 << 63) - 1
        own = marks.where((F.col("toxic") == toxic) & (place <= F.lit(end))).orderBy(place, "doc_id").limit(EXAMPLES)
        out = own if out is None else out.unionByName(own)
    return stored(out, "sample"), n1, n0


def worded(docs: DataFrame) -> DataFrame:
    """docs(doc_id, toxic, text): doc_id, toxic, its distinct words and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [words(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), pa.array([list(f) for f in found], pa.list_(pa.string())), pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))],
                ["doc_id", "toxic", "words", "counts"],
            )

    return docs.mapInArrow(run, "doc_id long, toxic int, words array<string>, counts array<int>")


def vectors(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """docs(doc_id, held_out, text): doc_id, held_out, and the packed ids and counts of the words of the vocabulary that the text has."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the words of at most 2 * EXAMPLES texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: i for i, w in enumerate(shared.value.to_pylist())}
        for batch in slices(batches):
            packed = []
            for text in batch.column("text").to_pylist():
                known = sorted((place[w], n) for w, n in words(text).items() if w in place)
                packed.append(pack(np.array([i for i, _ in known], np.int64), np.array([n for _, n in known], np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(packed, pa.binary())], ["doc_id", "held_out", "vector"])

    return docs.mapInArrow(run, "doc_id long, held_out boolean, vector binary")


def pack(ids: np.ndarray, counts: np.ndarray) -> bytes:
    return zlib.compress(np.concatenate([np.diff(ids, prepend=0), counts]).astype("<u4").tobytes(), 1)


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends (from 0), ids and counts of packed rows."""
    rows = [np.frombuffer(zlib.decompress(x), "<u4").astype(np.int64).reshape(2, -1) for x in column.to_pylist()]
    ends = np.cumsum([0, *(r.shape[1] for r in rows)])
    ids, counts = np.concatenate([np.zeros((2, 0), np.int64), *((np.cumsum(r[0]), r[1]) for r in rows)], 1)
    return ends, ids, counts


def frequencies(sparse: DataFrame, n_words: int) -> np.ndarray:
    """In how many rows of vectors each word occurs; each task sums its own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_words, np.int64)
        for batch in batches:
            total += np.bincount(unpacked(batch.column("vector"))[1], minlength=n_words)
        words = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(total[words])], ["word", "n"])

    sums = sparse.select("vector").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(n_words)
    df[sums.column("word").to_numpy()] = sums.column("n").to_numpy()
    return df


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ends (from 0) and values of an array of lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of several ranges, in a row."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Index:
    """Examples as rows (ends, ids, counts), with their doc_ids and classes; the weight of each word."""

    def __init__(self, ends: np.ndarray, ids: np.ndarray, counts: np.ndarray, doc_ids: np.ndarray, toxic: np.ndarray, word_weights: np.ndarray):
        self.word_weights = word_weights
        weights = self.weighted(ends, ids, counts)
        n, sizes = len(doc_ids), np.diff(ends)
        row = np.repeat(np.arange(n), sizes)
        uses = np.bincount(ids, minlength=len(word_weights))
        # like examples share blocks: they stand by their heaviest word that others have as well
        heavy = np.zeros(n, np.int64)
        order = np.lexsort((weights, row))
        order = order[uses[ids[order]] > 1]
        heavy[row[order]] = ids[order]
        place = np.lexsort((doc_ids, heavy))
        new = np.empty(n, np.int64)
        new[place] = np.arange(n)
        self.doc_ids, self.toxic = doc_ids[place], toxic[place].astype(float)
        row, self.n, self.blocks = new[row], n, -(-n // BLOCK)
        common = np.argsort(-uses, kind="stable")[:COMMON]
        self.common = np.full(len(word_weights), -1, np.int64)
        self.common[common] = np.arange(len(common))
        much = self.common[ids] >= 0
        self.dense = np.zeros((self.blocks * BLOCK, len(common)))
        self.dense[row[much], self.common[ids[much]]] = weights[much]
        self.most = self.dense.reshape(self.blocks, BLOCK, -1).max(1)
        order = np.flatnonzero(~much)[np.lexsort((row[~much], ids[~much]))]
        self.rows, self.weights = row[order].astype(np.int32), weights[order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(ids[order], minlength=len(word_weights)))])
        self.place = new

    def weighted(self, ends: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The weights of rows, each of length 1."""
        w = (1 + np.log(np.maximum(counts, 1))) * self.word_weights[ids]
        row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        size = np.sqrt(np.bincount(row, w * w, minlength=len(ends) - 1))
        return w / np.where(size > 0, size, 1)[row]

    def nearest(self, ends: np.ndarray, ids: np.ndarray, weights: np.ndarray, without: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query row the NEAREST examples by cosine (more than 0), best first, and their cosines. `without`: for
        each row an example's place that does not count."""
        n = len(ends) - 1
        row = np.repeat(np.arange(n), np.diff(ends))
        much = self.common[ids] >= 0
        dense = np.zeros((n, self.dense.shape[1]))
        dense[row[much], self.common[ids[much]]] = weights[much]
        few, own = ids[~much], weights[~much]
        sizes = self.starts[few + 1] - self.starts[few]
        at = _ranges(self.starts[few], sizes)
        wide = self.blocks * BLOCK
        sums = np.bincount(np.repeat(row[~much], sizes) * wide + self.rows[at], np.repeat(own, sizes) * self.weights[at], minlength=n * wide).reshape(n, wide)
        bound = sums.reshape(n, self.blocks, BLOCK).max(2) + dense @ self.most.T
        order = np.argsort(-bound, axis=1, kind="stable")
        best, seen = np.full((n, NEAREST), -1.0), np.zeros((n, self.blocks), bool)
        for turn in range(self.blocks):
            # every row asks for its next block; rows that ask for the same one are served together
            block = order[:, turn]
            top = bound[np.arange(n), block]
            left = np.flatnonzero((top > 0) & (top >= best[:, 0] - 1e-12))
            if not len(left):
                break
            for b in np.unique(block[left]):
                rows = left[block[left] == b]
                span = slice(b * BLOCK, (b + 1) * BLOCK)
                near = sums[rows, span] + dense[rows] @ self.dense[span].T
                near[:, max(0, self.n - b * BLOCK) :] = 0
                if without is not None:
                    out = np.flatnonzero(without[rows] // BLOCK == b)
                    near[out, without[rows[out]] % BLOCK] = 0
                sums[rows, span], seen[rows, b] = near, True
                # the best so far, in no order but for the least, which stands first
                best[rows] = np.partition(np.concatenate([best[rows], near], 1), -NEAREST, axis=1)[:, -NEAREST:]
        sums[~np.repeat(seen, BLOCK, axis=1)] = 0
        out = []
        for near, least in zip(sums, best[:, 0]):
            at = np.flatnonzero((near > 0) & (near >= least - 1e-12))
            at = at[np.lexsort((self.toxic[at], self.doc_ids[at], -np.round(near[at], 12)))[:NEAREST]]
            out.append((at, near[at]))
        return out

    def vote(self, found: np.ndarray, cosines: np.ndarray, of_class: tuple[float, float]) -> float:
        toxic = self.toxic[found]
        weight = np.where(toxic > 0, of_class[1], of_class[0]) / (HALF + np.maximum(0, 1 - cosines))
        return float((weight * toxic).sum() / weight.sum())


def curve(votes: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve from log-odds of votes to labels, by Newton steps with a small ridge."""
    x = np.column_stack([odds(votes), np.ones(len(votes))])
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        ridge = 0.1 * (beta - [1.0, 0.0])
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + 0.1 * np.eye(2), x.T @ (weight * (toxic - p)) - ridge)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return float(max(beta[0], 0.1)), float(beta[1])


def odds(votes: np.ndarray | float) -> np.ndarray:
    p = np.clip(votes, 0.02, 0.98)
    return np.log(p / (1 - p))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (doc_ids of the neighbours, best first) for every document."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = texts(docs).select(F.col("doc_id").cast("long"), held_out(F.col("doc_id").cast("long")).alias("held_out"), "text")
    marks = stored(labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long"), (F.col("toxic") != 0).cast("int").alias("toxic")).where(~held_out(F.col("doc_id"))).distinct(), "marks")
    sample, n1, n0 = sampled(marks)
    prior = n1 / (n1 + n0) if n1 + n0 else 0.0
    found = worded(rows.where("not held_out").join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text")).orderBy("doc_id", "toxic", "words", "counts").toArrow()  # at most 2 * EXAMPLES texts, and copies of their ids
    toxic = found.column("toxic").to_numpy()
    if len(set(toxic)) < 2:
        return rows.select("doc_id", "held_out", F.lit(prior).alias("score"), F.lit(int(prior >= THRESHOLD)).alias("predicted"), F.array().cast("array<bigint>").alias("evidence"))
    ends, terms = _lists(found.column("words"))
    vocabulary = pc.unique(pa.array(terms, pa.string()))
    ids = pc.index_in(pa.array(terms, pa.string()), vocabulary).to_numpy().astype(np.int64)
    sparse = stored(vectors(rows, vocabulary), "vectors")
    n_docs = sparse.count()
    df = np.maximum(frequencies(sparse, len(vocabulary)), 1)
    row = np.repeat(toxic, np.diff(ends))
    share = lambda kind: np.bincount(ids[row == kind], minlength=len(df)) / (toxic == kind).sum() + SMOOTH
    index = Index(ends, ids, _lists(found.column("counts"))[1].astype(float), found.column("doc_id").to_numpy(), toxic, np.log((n_docs + 1) / df) * np.log2(2 + share(1) / share(0)) ** 2)
    of_class = n0 / (toxic == 0).sum(), n1 / (toxic == 1).sum()
    own = index.weighted(ends, ids, _lists(found.column("counts"))[1].astype(float))
    near = [x for a in range(0, len(toxic), BATCH) for x in _some(index, ends, ids, own, a, min(a + BATCH, len(toxic)), index.place)]
    votes = np.array([index.vote(*x, of_class) if len(x[0]) else np.nan for x in near])
    known = ~np.isnan(votes)
    a, b = curve(votes[known], toxic[known].astype(float), np.where(toxic[known] > 0, of_class[1], of_class[0]))
    shared = spark.sparkContext.broadcast(index)  # postings of at most 2 * EXAMPLES texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                ends, ids, counts = unpacked(batch.column("vector"))
                near = index.nearest(ends, ids, index.weighted(ends, ids, counts.astype(float)))
                score = [float(1 / (1 + np.exp(-(a * odds(index.vote(*x, of_class)) + b)))) if len(x[0]) else prior for x in near]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array([int(s >= THRESHOLD) for s in score], pa.int32()), pa.array([index.doc_ids[x].tolist() for x, _ in near], pa.list_(pa.int64()))],
                    ["doc_id", "held_out", "score", "predicted", "evidence"],
                )

    # vectors are small, so Spark would put them into few tasks
    return sparse.repartition(max(1, n_docs // DEALT)).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, evidence array<bigint>")


def _some(index: Index, ends: np.ndarray, ids: np.ndarray, weights: np.ndarray, a: int, b: int, without: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The neighbours of the rows from a to b."""
    span = slice(ends[a], ends[b])
    return index.nearest(ends[a : b + 1] - ends[a], ids[span], weights[span], without[a:b])


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
