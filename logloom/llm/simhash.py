"""Operator 3: near-duplicates by SimHash fingerprints, found through the perfect binary Golay code.

Fingerprints are 64-bit majority votes over the XXH64 hashes of 4-word shingles. Two are linked at 4 or fewer differing
bits. To find every link, the 64 bits are cut into segments of 22, 21 and 21 bits, each padded to a 23-bit word. Four
errors leave either two segments with at most one error each, or one segment without any (errors 0, 2, 2):

* Every 23-bit word lies within distance 3 of exactly one codeword, its decoding. Words at distance 1 share it up to one
  step more: the decoding of one lies within distance 4 of the other. A word has 1 or 6 codewords that near. So each
  fingerprint is stored under the codeword indices within distance 4 of two of its segments (about 28 keys of 24 bits for
  each of the three pairs) and asked for under the decodings of both (one key a pair).
* A segment without errors is a key as it is.

Pairs that meet under a key are verified within the join; only links leave it. Equal fingerprints are one node from the
start, so copies cost nothing. Links become components.

Defined results: a null text is the empty text; texts without words have fingerprint zero and are linked like others;
a fingerprint bit with exactly half the votes is 0; rows with a null doc_id get a fingerprint, and the component of the
smallest known doc_id in reach, or null; repeated rows and ties need no rule; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, small_batches, stored, table, texts
from .graph import components

SHINGLE, SEED, MOST_BITS = 4, 42, 4
#: First bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Generator polynomial of the [23, 12, 7] Golay code.
GENERATOR = 0b101011100011
#: Shingles whose hashes are held at once.
BLOCK = 1 << 16


def fingerprint(text: str) -> int:
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    n, digest = max(1, len(words) - SHINGLE + 1), xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for start in range(0, n, BLOCK):
        own = words[start : start + BLOCK + SHINGLE - 1]
        shingles = map(b" ".join, zip(own, own[1:], own[2:], own[3:])) if len(words) >= SHINGLE else [b" ".join(own)]
        hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), for every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return texts(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial."""
    words = words.astype(np.int64)
    for bit in range(22, 10, -1):
        words = np.where(words >> bit & 1, words ^ GENERATOR << bit - 11, words)
    return words


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the error of the nearest codeword; how many codewords lie within distance 4, 1 or 6; and those errors."""
    nearest = np.zeros(2048, np.int64)
    for weight in range(4):
        for bits in itertools.combinations(range(23), weight):
            error = sum(1 << b for b in bits)
            nearest[syndrome(np.array([error]))[0]] = error
    data = np.arange(4096, dtype=np.int64) << 11
    code = data ^ syndrome(data)
    errors, counts = np.zeros((2048, 6), np.int64), np.zeros(2048, np.int64)
    for s in range(2048):
        near = nearest[s] ^ code
        near = near[np.bitwise_count(near.astype(np.uint64)) <= 4]
        counts[s] = len(near)
        errors[s] = near[np.arange(6) % len(near)]
    return nearest, counts, errors


def segments(fps: np.ndarray) -> list[np.ndarray]:
    return [(fps >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]


def keys(fps: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Keys to ask for, and keys to store under: each the keys, and the rows that they belong to. The kind of key (pair or
    segment) stands above its bits."""
    nearest, counts, errors = golay()
    parts = segments(fps)
    signs = [syndrome(p) for p in parts]
    rows, ask, store = np.arange(len(fps)), ([], []), ([], [])
    for kind, (i, j) in enumerate(PAIRS):
        joint = lambda a, b, k=kind: k << 32 | (a >> 11) << 12 | b >> 11
        ask[0].append(joint(parts[i] ^ nearest[signs[i]], parts[j] ^ nearest[signs[j]]))
        ask[1].append(rows)
        for a in range(6):
            for b in range(6):
                own = rows[(a < counts[signs[i]]) & (b < counts[signs[j]])]
                store[0].append(joint(parts[i][own] ^ errors[signs[i][own], a], parts[j][own] ^ errors[signs[j][own], b]))
                store[1].append(own)
    for k, part in enumerate(parts):
        for out in (ask, store):
            out[0].append(3 + k << 32 | part)
            out[1].append(rows)
    return tuple((np.concatenate(k), np.concatenate(r)) for k, r in (ask, store))  # type: ignore[return-value]


def links(nodes: DataFrame) -> DataFrame:
    """nodes(fp): distinct fingerprints. Returns a, b (a < b): those that differ in 4 or fewer bits."""

    def keyed(side: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fps = batch.column("fp").to_numpy()
                key, row = keys(fps.view(np.uint64))[side]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row])], ["key", "fp"])

        return nodes.mapInArrow(run, "key long, fp long")

    ask, store = keyed(0).withColumnRenamed("fp", "a"), keyed(1).withColumnRenamed("fp", "b").withColumnRenamed("key", "at")
    near = (F.col("key") == F.col("at")) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_BITS)
    # never broadcast: Spark takes the keys' size for that of the few columns they are made of, which is far too small
    return ask.join(store.hint("merge"), near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id in reach) for every row."""
    prints = stored(fingerprints(docs), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    linked = components(links(nodes.select("fp")))
    linked = linked.select(F.col("node").alias("fp"), F.col("component").alias("root"))
    rooted = nodes.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    roots = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = stored(rooted.join(roots, "root").select("fp", "component_id"), "components")
    return prints.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
