"""Operator 4: log-bilinear language model, trained in numpy with noise-contrastive estimation.

The model knows the end, the WORDS most frequent training tokens, and one word for all others. They stand in GROUPS groups,
ranges of falling frequency with about equal sums of the roots of their counts. From the two words before a token, a
context vector is made by a linear map of each one's vector; a group's score is its product with the group's own vector,
plus a bias, and so is the score of each word of the group. The probability of a word is that of its group times its own
within the group. Training tells true groups and words from noise drawn by their frequency, so no normaliser is needed there;
scoring takes batched matrix products over all groups and over the words of the token's group, so each token's log
probability is exactly normalised. The word for all others also pays for the token itself, by its smoothed count. The base
score is that of smoothed counts alone.

Training starts on the driver with SAMPLE training documents, the first by a hash of id and text. Then all training documents
are dealt by that hash to blocks, of BLOCK_TOKENS tokens or more, MOST_BLOCKS at most; each block is learned in the order of
the hash, from the same start, and the vectors are averaged by how often their words occurred. So neither scores nor
weights depend on partitions, but for rounding.

Counts cover all training documents. A text is read once: each task cuts its documents into chunks of bounded size,
writes their tokens as numbers local to the chunk, and the chunk's distinct tokens as its dictionary. Dictionaries meet
the counts by token, and their own chunk by its number; texts and the vocabulary are never held whole.

Defined results: a null or empty text is the end alone; a null doc_id is dealt as the text "null"; without training
documents counts are 0 and the model is uniform; ties in frequency go to the smaller token; repeated rows count each;
very long texts are a chunk of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, small_batches, stored, table, texts

WORDS, GROUPS, WIDTH = 16_384, 128, 20
END, OTHER, FIRST = 0, 1, 2
SAMPLE, EPOCHS = 500, 3
#: Tokens of a step, noise groups of a step, noise words of a group and step, noise for each token, and learning rate.
BATCH, NOISE, NOISE_WORDS, RATIO, RATE = 32_768, 24, 12, 8, 0.08
#: Bytes of text in a chunk, tokens that are scored at once, and scores held at once.
CHUNK, PIECE, SCORES = 12 << 20, 1 << 16, 1 << 21
#: Tokens of a block at least, blocks at most, and blocks that are averaged in one task.
BLOCK_TOKENS, MOST_BLOCKS, FAN = 4_000_000, 4096, 8


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null"))) % 5 == 1


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


class Words(NamedTuple):
    """The words' counts, smoothed, in the order of their numbers: end, all others, then by falling count; and their groups."""

    sizes: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, sizes: np.ndarray) -> Words:
        roots = np.cumsum(np.sqrt(sizes[FIRST:]))
        group = np.minimum((roots / roots[-1] * (GROUPS - 2)).astype(np.int64), GROUPS - 3) if len(roots) else np.zeros(0, np.int64)
        return cls(sizes, np.concatenate([[0, 1], FIRST + np.flatnonzero(np.diff(group, prepend=-1)), [len(sizes)]]))

    @property
    def group(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    @property
    def masses(self) -> np.ndarray:
        return np.add.reduceat(self.sizes, self.starts[:-1]) / self.sizes.sum()


class Model:
    """Weights in one flat array: the words' vectors as context, their vectors and biases within their groups, those of the
    groups, two maps."""

    def __init__(self, flat: np.ndarray, words: int, groups: int):
        self.flat, self.parts, at = flat, [], 0
        for shape in self.shapes(words, groups):
            n = int(np.prod(shape))
            self.parts.append(flat[at : at + n].reshape(shape))
            at += n

    @staticmethod
    def shapes(words: int, groups: int) -> list[tuple[int, ...]]:
        return [(words, WIDTH), (words, WIDTH + 1), (groups, WIDTH + 1), (WIDTH, WIDTH), (WIDTH, WIDTH)]

    @classmethod
    def fresh(cls, words: Words) -> Model:
        n, groups = len(words.sizes), len(words.starts) - 1
        rng = np.random.default_rng(0)
        model = cls(np.zeros(sum(int(np.prod(s)) for s in cls.shapes(n, groups)), np.float32), n, groups)
        for part in model.parts[:3]:
            part[:] = rng.normal(0, 0.1, part.shape)
        for part in model.parts[3:]:
            part[:] = np.eye(WIDTH)
        model.parts[1][:, -1] = np.log(words.sizes / words.sizes.sum() / words.masses[words.group])
        model.parts[2][:, -1] = np.log(words.masses)
        return model


class Trainer:
    """A model in training. seen: how often each word was a context and a target."""

    def __init__(self, words: Words, flat: np.ndarray, squares: np.ndarray, seed: int):
        n, groups = len(words.sizes), len(words.starts) - 1
        self.model, self.squares = Model(flat, n, groups), Model(squares, n, groups)
        # small types are sorted by radix
        self.group, self.starts, self.masses = words.group.astype(np.uint8), words.starts.tolist(), words.masses
        self.alone = np.diff(words.starts) == 1
        self.log_noise = (np.log(self.masses) + np.log(RATIO)).astype(np.float32)
        self.log_within = (np.log(words.sizes / words.sizes.sum() / self.masses[words.group]) + np.log(RATIO)).astype(np.float32)
        self.ends = np.concatenate([[0], np.cumsum(words.sizes)])
        self.rng = np.random.default_rng(seed)
        self.held: list[np.ndarray] = []
        self.n_held = 0
        self.seen = np.zeros((2, n), np.int64)

    def add(self, ids: np.ndarray) -> None:
        """The words of a document, the end included."""
        self.held.append(triples_of(ids))
        self.n_held += len(ids)
        if self.n_held >= BATCH:
            triples = np.concatenate(self.held, 1)
            whole = self.n_held // BATCH * BATCH
            for start in range(0, whole, BATCH):
                self.step(*triples[:, start : start + BATCH])
            self.held, self.n_held = [triples[:, whole:]], self.n_held - whole

    def flush(self) -> None:
        if self.n_held:
            self.step(*np.concatenate(self.held, 1))
        self.held, self.n_held = [], 0

    def step(self, b: np.ndarray, a: np.ndarray, w: np.ndarray) -> None:
        """A step on tokens w with the words before them (a) and before these (b)."""
        context, own, of_group, one, two = self.model.parts
        order = np.argsort(self.group[w], kind="stable")
        b, a, w = b[order], a[order], w[order]
        g = self.group[w]
        first = _starts(g)
        before, further = context[a], context[b]
        q = np.ones((len(w), WIDTH + 1), np.float32)
        q[:, :-1] = before @ one
        q[:, :-1] += further @ two
        # groups against groups
        noise = self.rng.choice(len(self.masses), NOISE, p=self.masses)
        mine, others = of_group[g], of_group[noise]
        up = 1 - _logistic(np.einsum("ij,ij->i", q, mine) - self.log_noise[g])
        down = _logistic(q @ others.T - self.log_noise[noise]) * np.float32(-RATIO / NOISE)
        to_q = up[:, None] * mine
        to_q += down @ others
        of_groups = np.concatenate([g[first], noise]).astype(np.uint8), np.concatenate([np.add.reduceat(up[:, None] * q, first), down.T @ q])
        # words against words of their group
        mine = own[w]
        up = 1 - _logistic(np.einsum("ij,ij->i", q, mine) - self.log_within[w])
        up[self.alone[g]] = 0
        to_q += up[:, None] * mine
        ids, grads = [w], [up[:, None] * q]
        for k, start, end in zip(g[first].tolist(), first.tolist(), [*first[1:].tolist(), len(g)]):
            if self.alone[k]:
                continue
            lo, hi = self.starts[k], self.starts[k + 1]
            mass = self.ends[lo] + self.rng.random(NOISE_WORDS) * (self.ends[hi] - self.ends[lo])
            noise = np.minimum(np.searchsorted(self.ends, mass, side="right") - 1, hi - 1)
            others, here = own[noise], q[start:end]
            down = _logistic(here @ others.T - self.log_within[noise]) * np.float32(-RATIO / NOISE_WORDS)
            to_q[start:end] += down @ others
            ids.append(noise)
            grads.append(down.T @ here)
        self._move(1, np.concatenate(ids).astype(np.uint16), np.concatenate(grads))
        self._move(2, *of_groups)
        to_q = to_q[:, :-1]
        self._move(0, np.concatenate([a, b]), np.concatenate([to_q @ one.T, to_q @ two.T]))
        self._move(3, None, before.T @ to_q)
        self._move(4, None, further.T @ to_q)
        n = len(self.group)
        self.seen[0] += np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
        self.seen[1] += np.bincount(w, minlength=n)

    def _move(self, part: int, rows: np.ndarray | None, grads: np.ndarray) -> None:
        """A step along the gradients, by Adagrad; gradients of the same row are summed first."""
        if rows is None:
            at: np.ndarray | slice = slice(None)
        else:
            order = np.argsort(rows, kind="stable")
            rows = rows[order]
            first = _starts(rows)
            at, grads = rows[first], np.add.reduceat(grads[order], first, axis=0)
        squares = self.squares.parts[part][at] + grads**2
        self.squares.parts[part][at] = squares
        self.model.parts[part][at] += np.float32(RATE) * grads / np.sqrt(squares + np.float32(1e-8))


def _starts(values: np.ndarray) -> np.ndarray:
    """The places where runs of equal values start."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def triples_of(ids: np.ndarray) -> np.ndarray:
    """Three rows: the words two before and one before each word, and the word. Documents may stand in a row; each starts
    behind two ends."""
    before = np.concatenate([[END], ids[:-1]])
    further = np.concatenate([[END], before[:-1]])
    return np.stack([np.where(before == END, END, further), before, ids]).astype(np.uint16)


class Scorer:
    """Log probabilities (natural) of tokens."""

    def __init__(self, words: Words, flat: np.ndarray):
        self.starts, self.group = words.starts, words.group.astype(np.uint8)
        context, self.own, self.of_group, one, two = Model(flat, len(words.sizes), len(words.starts) - 1).parts
        self.first, self.second = context @ one, context @ two

    def scores(self, triples: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(self._piece(*triples[:, at : at + PIECE]) for at in range(0, triples.shape[1], PIECE))])

    def _piece(self, b: np.ndarray, a: np.ndarray, w: np.ndarray) -> np.ndarray:
        code, at = np.unique(b.astype(np.int64) << 16 | a, return_inverse=True)
        q = np.ones((len(code), WIDTH + 1), np.float32)
        q[:, :-1] = self.first[code & 0xFFFF] + self.second[code >> 16]
        norm = self._norms(q, self.of_group)
        order = np.argsort(self.group[w], kind="stable")
        at, w = at[order], w[order]
        g, q = self.group[w], q[at]
        out = np.einsum("ij,ij->i", q, self.of_group[g]) - norm[at]
        within = np.einsum("ij,ij->i", q, self.own[w])
        first = _starts(g)
        for start, end in zip(first, [*first[1:], len(g)]):
            lo, hi = self.starts[g[start]], self.starts[g[start] + 1]
            if hi - lo > 1:
                out[start:end] += within[start:end] - self._norms(q[start:end], self.own[lo:hi])
        scores = np.empty(len(w))
        scores[order] = out
        return scores

    @staticmethod
    def _norms(q: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        step = max(1, SCORES // len(vectors))
        return np.concatenate([_log_sum(q[i : i + step] @ vectors.T) for i in range(0, len(q), step)])


def _log_sum(scores: np.ndarray) -> np.ndarray:
    """The logarithm of the sum of each row's exponentials."""
    with np.errstate(over="ignore", divide="ignore"):
        out = np.log(np.exp(scores).sum(1))
    odd = np.flatnonzero(~np.isfinite(out))
    if len(odd):
        top = scores[odd].max(1)
        out[odd] = top + np.log(np.exp(scores[odd] - top[:, None]).sum(1))
    return out


def chunks(docs: DataFrame) -> DataFrame:
    """docs(doc_id, held_out, place, text), read once. Rows of two kinds: a document's token numbers (packed), and a chunk's
    dictionary with the counts of its training documents."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for i, batch in enumerate(slices(_joined(batches), most=CHUNK)):
            chunk, numbers, counts = task << 32 | i, {}, []
            rows = []
            for doc_id, out, place_, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held_out", "place", "text"))):
                ids = np.array([numbers.setdefault(w, len(numbers)) for w in tokens(text)], np.int32)
                rows.append((doc_id, out, place_, ids))
                if not out:
                    counts.append(ids)
            counts = np.bincount(np.concatenate([np.zeros(0, np.int32), *counts]), minlength=len(numbers))
            # frequent tokens get small numbers, which pack better
            order = np.argsort(-counts, kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            names = list(numbers)
            packed = [zlib.compress(place[ids].astype("<u4").tobytes(), 1) for _, _, _, ids in rows]
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([chunk] * (n + 1), pa.int64()),
                    pa.array([*(r[0] for r in rows), None], pa.int64()),
                    pa.array([*(r[1] for r in rows), None], pa.bool_()),
                    pa.array([*(r[2] for r in rows), None], pa.int64()),
                    pa.array([*packed, None], pa.binary()),
                    pa.array([None] * n + [[names[j] for j in order]], pa.list_(pa.binary())),
                    pa.array([None] * n + [counts[order].tolist()], pa.list_(pa.int64())),
                ],
                ["chunk", "doc_id", "held_out", "place", "ids", "tokens", "counts"],
            )

    return docs.mapInArrow(run, "chunk long, doc_id long, held_out boolean, place long, ids binary, tokens array<binary>, counts array<bigint>")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have a chunk's bytes."""
    own: list[pa.RecordBatch] = []
    for batch in batches:
        own.append(batch)
        if sum(b.nbytes for b in own) >= CHUNK:
            yield pa.Table.from_batches(own).combine_chunks().to_batches()[0]
            own = []
    if own and sum(b.num_rows for b in own):
        yield pa.Table.from_batches(own).combine_chunks().to_batches()[0]


def packed_words(ids: np.ndarray) -> bytes:
    return zlib.compress(ids.astype("<u2").tobytes(), 1)


def unpacked_words(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), "<u2").astype(np.int64)


def coded(packed: DataFrame, counts: DataFrame, frequent: list[bytes], base: tuple[float, float, float], ends: int) -> DataFrame:
    """doc_id, held_out, place, n_tokens, n_known, base_score, within (log10 probability of tokens among all others), words
    (the numbers that the model knows, packed). base: denominator of the base score, that of all others, score of an end."""
    spark = packed.sparkSession
    below, rest, end_score = base
    numbers = spark.createDataFrame([(w, i + FIRST) for i, w in enumerate(frequent)], "token binary, word int")  # WORDS rows at most
    dictionary = packed.where("tokens is not null").select("chunk", F.posexplode("tokens").alias("number", "token"))
    known = dictionary.join(counts.join(F.broadcast(numbers), "token", "left"), "token", "left").select(F.col("chunk").alias("own"), "number", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("word", F.lit(OTHER)).alias("word"))

    def run(docs: pa.Table, own: pa.Table) -> pa.Table:
        n = own.num_rows
        c, word = np.zeros(n), np.zeros(n, np.int64)
        at = own.column("number").to_numpy()
        c[at], word[at] = own.column("c").to_numpy(), own.column("word").to_numpy()
        by_count = np.log10((c + 0.5) / below)
        within = np.where(word == OTHER, np.log10((c + 0.5) / rest), 0.0)
        out: list[list] = [[] for _ in range(5)]
        for ids in docs.column("ids").to_pylist():
            ids = np.frombuffer(zlib.decompress(ids), "<u4")
            row = len(ids) + 1, int((c[ids] > 0).sum()) + int(ends > 0), float(by_count[ids].sum()) + end_score, float(within[ids].sum()), packed_words(np.append(word[ids], END))
            for column, value in zip(out, row):
                column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
        return pa.Table.from_arrays([*(docs.column(k) for k in ("doc_id", "held_out", "place")), *map(pa.array, out, kinds)], ["doc_id", "held_out", "place", "n_tokens", "n_known", "base_score", "within", "words"])

    docs = packed.where("ids is not null").select("chunk", "doc_id", "held_out", "place", "ids")
    schema = "doc_id long, held_out boolean, place long, n_tokens long, n_known long, base_score double, within double, words binary"
    return docs.groupBy("chunk").cogroup(known.groupBy("own")).applyInArrow(run, schema)


def trained(rows: DataFrame, words: Words, n_docs: int, n_tokens: int) -> np.ndarray:
    """rows(doc_id, place, words): training documents, n_docs of n_tokens. The weights."""
    spark = rows.sparkSession
    model = Model.fresh(words)
    if not n_docs:
        return model.flat
    # the hashes' lower end holds SAMPLE documents and a few more, so that few rows meet in the cut
    end = int((1 << 64) * min(1.0, (SAMPLE + 10 * SAMPLE**0.5) / n_docs)) - (1 << 63) - 1
    start = [unpacked_words(r.words) for r in rows.where(F.col("place") <= F.lit(end)).orderBy("place", "doc_id").limit(SAMPLE).select("words").collect()]
    own = Trainer(words, model.flat, np.zeros_like(model.flat), 0)
    for _ in range(EPOCHS):
        for ids in start:
            own.add(ids)
        own.flush()
    first = spark.sparkContext.broadcast((words, model.flat, own.squares.flat))  # of the model's size
    n_blocks = max(1, min(MOST_BLOCKS, n_tokens // BLOCK_TOKENS))
    kinds = pa.schema([("block", pa.int64()), ("weights", pa.binary()), ("seen", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, flat, squares = first.value
        own, block = None, None

        def done() -> pa.RecordBatch:
            own.flush()
            return pa.RecordBatch.from_pylist([{"block": block, "weights": own.model.flat.tobytes(), "seen": own.seen.tobytes()}], kinds)

        for batch in batches:
            for k, data in zip(batch.column("block").to_pylist(), batch.column("words").to_pylist()):
                if k != block:
                    if own is not None:
                        yield done()
                    own, block = Trainer(words, flat.copy(), squares.copy(), k + 1), k
                own.add(unpacked_words(data))
        if own is not None:
            yield done()

    def averaged(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        flat, seen = average(rows, *first.value[:2])
        return pa.Table.from_pylist([{"block": rows[0]["block"] // FAN, "weights": flat.tobytes(), "seen": seen.tobytes()}], kinds)

    dealt = rows.select(F.pmod("place", F.lit(n_blocks)).alias("block"), "place", "doc_id", "words").repartitionById(n_blocks, F.col("block").cast("int"))
    sums = stored(dealt.sortWithinPartitions("block", "place", "doc_id").mapInArrow(run, "block long, weights binary, seen binary"), "weights")
    n = n_blocks
    while n > FAN:
        sums = stored(sums.groupBy(F.floor(F.col("block") / FAN).alias("g")).applyInArrow(averaged, "block long, weights binary, seen binary"), "weights")
        n = -(-n // FAN)
    return average(sorted(sums.toArrow().to_pylist(), key=lambda r: r["block"]), words, model.flat)[0]  # FAN models at most


def average(rows: list[dict], words: Words, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean of the models' weights, each word's by how often it was seen (where never: the start), the rest by tokens."""
    n, groups = len(words.sizes), len(words.starts) - 1
    total = Model(np.zeros(len(start)), n, groups)
    seen = np.zeros((2, n), np.int64)
    for r in rows:
        own, k = Model(np.frombuffer(r["weights"], np.float32), n, groups), np.frombuffer(r["seen"], np.int64).reshape(2, n)
        by = [k[0][:, None], k[1][:, None], *[k[1].sum()] * 3]
        for t, o, x in zip(total.parts, own.parts, by):
            t += o * x
        seen += k
    by = [seen[0][:, None], seen[1][:, None], *[seen[1].sum()] * 3]
    for t, s, x in zip(total.parts, Model(start, n, groups).parts, by):
        t[:] = np.where(x > 0, t / np.maximum(x, 1), s)
    return total.flat.astype(np.float32), seen


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document."""
    spark = docs.sparkSession
    doc_id = F.col("doc_id").cast("long")
    rows = texts(docs).select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), F.xxhash64(doc_id, "text").alias("place"), "text")
    packed = stored(chunks(rows), "chunks")
    own = packed.where("tokens is not null").select(F.explode(F.arrays_zip("tokens", "counts")).alias("x")).select(F.col("x.tokens").alias("token"), F.col("x.counts").alias("n"))
    counts = stored(own.where("n > 0").groupBy("token").agg(F.sum("n").alias("c")), "counts")
    total = counts.agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("c")).first()
    ends = packed.where("ids is not null and not held_out").count()
    top = counts.orderBy(F.col("c").desc(), "token").limit(WORDS).toArrow()  # a fixed number of rows
    # the end is a token as well, counted once a training document
    v, n = total.v + (ends > 0), (total.c or 0) + ends
    c_top = np.array(top.column("c").to_pylist(), float)
    words = Words.of(np.concatenate([[ends, n - ends - c_top.sum()], c_top]) + 0.5)
    below = n + 0.5 * (v + 1)
    rest = (n - ends - c_top.sum()) + 0.5 * (v - (ends > 0) - len(c_top) + 1)
    all_rows = stored(coded(packed, counts, top.column("token").to_pylist(), (below, rest, float(np.log10((ends + 0.5) / below))), ends), "coded")
    flat = trained(all_rows.where("not held_out"), words, ends, n)
    shared = spark.sparkContext.broadcast((words, flat))  # of the model's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            ids = [unpacked_words(x) for x in batch.column("words").to_pylist()]
            ends = np.cumsum([0, *map(len, ids)])
            by_word = scorer.scores(triples_of(np.concatenate([np.zeros(0, np.int64), *ids])))
            score = np.add.reduceat(by_word, ends[:-1]) / np.log(10) if len(ids) else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known")), pa.array([n] * len(ids), pa.int64()), batch.column("base_score"), pa.array(score + batch.column("within").to_numpy())],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return all_rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
