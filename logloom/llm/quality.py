"""Operator 7: quality rules with robust multivariate outliers.

Base rules read whole-text counts. The method adds a verdict on the transformed statistic vector of a document: how far,
in Mahalanobis distance, it lies from the minimum-covariance-determinant estimate of its language and source.

The estimates cover all rows of a group without gathering them: vectors are counted in the cells of a fixed grid, each
cell with its count, sums and products, so a group is at most GRID cells whatever its size, and the mean and covariance
of any set of whole cells are exact. On the cells of a group, concentration steps run from three robust starts until the
half with the smallest distances settles; the start with the least determinant wins, its covariance is made consistent
for normal data, and one reweighting step follows. A group with fewer than LEAST_ROWS rows takes its language's
estimate, a small language that of all rows; with too few rows altogether nothing is rejected.

Verdicts are made to leave clean documents alone: spreads have a floor (FLOOR), for many statistics hardly vary among
clean texts, and the cut-off is far out (CUT).

Defined results: a null or empty text has no words and fails the base rules; null languages and sources are groups of
their own; very long texts are read whole; repeated rows count each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, small_batches, stored, table

LEAST_WORDS, MOST_REPEATED = 20, 30
WINDOW, SYMBOLS, SPACE = 8, "#*$%&|<>", " \t\n\v\f\r"

FEATURES = ("word_length", "symbols", "marks", "capitals", "variety")
#: Least standard deviation of each feature, in its own unit.
FLOOR = (0.06, 0.04, 0.06, 0.08, 0.12)
#: Width of a grid cell in each feature, the first cell, and how many there are; what lies beyond is in the last one.
STEP, FIRST, SPAN = (0.08, 0.06, 0.06, 0.08, 0.12), (10, 0, 0, 0, -4), 18
GRID = SPAN ** len(FEATURES)
#: Squared distance beyond which a document goes: chi-squared with 5 degrees of freedom passes it once in 10^9 times.
CUT = 51.0
#: The 0.975 point of chi-squared with 5 degrees of freedom, for reweighting; its median, for consistency.
INNER, MIDDLE = 12.833, 4.351
LEAST_ROWS = 200

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATS = ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, " + ", ".join(f"{f} double" for f in FEATURES)


def repeated_words(words: list[bytes]) -> int:
    """Words in 8-word windows that occur twice or more. Equal windows get equal numbers by doubling: pairs of numbers of
    n-word windows are numbered anew for 2n words, so nothing is hashed away."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    width = 1
    while width < WINDOW:
        pair = ids[:-width] * (int(ids.max()) + 1) + ids[width:]
        distinct, ids, times = np.unique(pair, return_inverse=True, return_counts=True)
        width *= 2
        if len(distinct) == len(pair):
            return 0
    again = times[ids] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(again), 1)
    np.add.at(cover, np.flatnonzero(again) + WINDOW, -1)
    return int((np.cumsum(cover) > 0).sum())


def measure(text: str | None) -> dict:
    """The counts of the contract, the base verdict, and the transformed vector."""
    text = text or ""
    words = text.encode("utf-8", "replace").split()
    n = len(words)
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    out = {
        "n_words": n,
        "word_chars": (chars := len(text) - sum(map(text.count, SPACE))),
        "n_symbols": (symbols := sum(map(text.count, SYMBOLS))),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": (repeated := repeated_words(words)),
        "base_failed": n < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n,
    }
    marks = sum(map(text.count, ".,;:!?"))
    capitals = sum(map(str.isupper, text))
    distinct = len(set(words))
    vector = (
        math.log((chars + 1) / (n + 1)),
        math.sqrt(symbols / (chars + 1)),
        math.sqrt(marks / (chars + 1)),
        math.sqrt(capitals / (chars + 1)),
        math.log((distinct + 1) / (n + 1) ** 0.8),
    )
    return out | dict(zip(FEATURES, vector, strict=True))


def measured(docs: DataFrame, row: Column) -> DataFrame:
    """docs(text, lang, source): row, lang, source, m (the statistics). Texts are measured once; what a task has measured is
    written with the row."""
    own = docs.select(row.alias("row"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.struct([*((c, pa.int64()) for c in COUNTS), ("base_failed", pa.bool_()), *((f, pa.float64()) for f in FEATURES)])
        for batch in slices(batches):
            stats = pa.array([measure(t) for t in batch.column("text").to_pylist()], kinds)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "lang", "source")), stats], ["row", "lang", "source", "m"])

    schema = own.drop("text").withColumn("m", F.lit(None).cast(f"struct<{STATS.replace(' long', ':long').replace(' double', ':double').replace(' boolean', ':boolean')}>")).schema
    return own.mapInArrow(run, schema)


class Cells(NamedTuple):
    """Rows of a group by cell: how many, their sums, and the sums of their products (of features i and j, j up to i)."""

    n: np.ndarray
    sums: np.ndarray
    products: np.ndarray

    def some(self, of: np.ndarray) -> Cells:
        return Cells(self.n[of], self.sums[of], self.products[of])


def _moments(cells: Cells) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, mean and covariance of the rows in some cells."""
    d, n = len(FEATURES), float(cells.n.sum())
    mean = cells.sums.sum(0) / n
    second = np.zeros((d, d))
    second[np.tril_indices(d)] = cells.products.sum(0) / n
    second = second + np.tril(second, -1).T
    return n, mean, second - np.outer(mean, mean)


def _floored(cov: np.ndarray) -> np.ndarray:
    return cov + np.diag(np.maximum(np.square(FLOOR) - np.diag(cov), 1e-12))


def _distances(points: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    away = points - mean
    return np.einsum("ij,jk,ik->i", away, np.linalg.inv(_floored(cov)), away)


def _half(cells: Cells, points: np.ndarray, far: np.ndarray) -> np.ndarray:
    """The cells that hold the nearer half of the rows."""
    order = np.lexsort((*points.T, far))
    before = np.cumsum(cells.n[order]) - cells.n[order]
    out = np.zeros(len(cells.n), bool)
    out[order[before < (cells.n.sum() + len(FEATURES) + 1) / 2]] = True
    return out


def determinant_estimate(cells: Cells) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of a group, from its cells."""
    points, weight = cells.sums / cells.n[:, None], cells.n

    def middle(values: np.ndarray) -> float:
        order = np.argsort(values, kind="stable")
        return float(values[order[np.searchsorted(np.cumsum(weight[order]), weight.sum() / 2)]])

    centre = np.array([middle(x) for x in points.T])
    spread = np.maximum([1.4826 * middle(np.abs(x - c)) for x, c in zip(points.T, centre)], FLOOR)
    scaled = (points - centre) / spread
    starts = [np.square(scaled).sum(1), np.abs(scaled).max(1), np.square(np.tanh(scaled)).sum(1)]
    best: tuple[float, np.ndarray, np.ndarray] | None = None
    for far in starts:
        own = _half(cells, points, far)
        for _ in range(30):
            _, mean, cov = _moments(cells.some(own))
            after = _half(cells, points, _distances(points, mean, cov))
            if (after == own).all():
                break
            own = after
        _, mean, cov = _moments(cells.some(own))
        size = float(np.linalg.slogdet(_floored(cov))[1])
        if best is None or size < best[0] - 1e-12:
            best = size, mean, cov
    assert best is not None
    _, mean, cov = best
    cov = cov * max(1.0, middle(_distances(points, mean, cov)) / MIDDLE)
    inner = _distances(points, mean, cov) <= INNER
    if inner.any():
        _, mean, cov = _moments(cells.some(inner))
    return mean, _floored(cov)


def _fit(table: pa.Table) -> pa.Table:
    """A group's estimate; nulls if it is too small for one."""
    d = range(len(FEATURES))
    column = lambda c: table.column(c).to_numpy()
    order = np.lexsort([column(f"c{i}") for i in reversed(d)])
    cells = Cells(column("n"), np.column_stack([column(f"s{i}") for i in d]), np.column_stack([column(f"p{i}{j}") for i in d for j in range(i + 1)])).some(order)
    mean, inverse = None, None
    if cells.n.sum() >= LEAST_ROWS:
        mean, cov = determinant_estimate(cells)
        mean, inverse = mean.tolist(), np.linalg.inv(cov).ravel().tolist()
    kinds = pa.schema([("level", pa.int32()), ("lang", pa.string()), ("source", pa.string()), ("mean", pa.list_(pa.float64())), ("inverse", pa.list_(pa.float64()))])
    return pa.Table.from_pylist([{**{c: table.column(c)[0].as_py() for c in ("level", "lang", "source")}, "mean": mean, "inverse": inverse}], kinds)


def estimates(rows: DataFrame) -> DataFrame:
    """rows(lang, source, and m with the features). Returns lang, source, mean, inverse for each pair of them; null
    arrays where nothing may be rejected. Rows that fail the base rules don't count."""
    d = range(len(FEATURES))
    value = [F.col(f"m.{f}") for f in FEATURES]
    cell = [F.least(F.greatest(F.floor(v / w), F.lit(a)), F.lit(a + SPAN - 1)).cast("int").alias(f"c{i}") for i, (v, w, a) in enumerate(zip(value, STEP, FIRST))]
    sums = [F.count(F.lit(1)).alias("n"), *(F.sum(v).alias(f"s{i}") for i, v in enumerate(value)), *(F.sum(value[i] * value[j]).alias(f"p{i}{j}") for i in d for j in range(i + 1))]
    cells = stored(rows.where("not m.base_failed").groupBy("lang", "source", *cell).agg(*sums), "cells")
    again = [F.sum(c).alias(c) for c in cells.columns if c[0] in "nsp" and c != "source"]
    nothing = F.lit(None).cast("string")
    own = [f"c{i}" for i in d]
    levels = (
        cells.withColumn("level", F.lit(0))
        .unionByName(cells.groupBy("lang", *own).agg(*again).withColumns({"source": nothing, "level": F.lit(1)}))
        .unionByName(cells.groupBy(*own).agg(*again).withColumns({"lang": nothing, "source": nothing, "level": F.lit(2)}))
    )
    fits = stored(levels.groupBy("level", "lang", "source").applyInArrow(_fit, "level int, lang string, source string, mean array<double>, inverse array<double>"), "fits")
    level = lambda k: fits.where(F.col("level") == k).drop("level").alias(f"f{k}")
    pairs = level(0).join(level(1), F.expr("f0.lang <=> f1.lang"), "left")
    overall = fits.where("level = 2").first()  # one row
    whole = {c: F.lit(None) if overall is None or overall[c] is None else F.array(*map(F.lit, overall[c])) for c in ("mean", "inverse")}
    pick = lambda c: F.coalesce(F.col(f"f0.{c}"), F.col(f"f1.{c}"), whole[c]).alias(c)
    return stored(pairs.select(F.col("f0.lang").alias("lang"), F.col("f0.source").alias("source"), pick("mean"), pick("inverse")), "estimates")


def _verdict() -> Column:
    """Whether a row with m and its group's estimate is kept."""
    away = [F.col(f"m.{f}") - F.get("mean", F.lit(i)) for i, f in enumerate(FEATURES)]
    d = len(FEATURES)
    far = sum((away[i] * away[j] * F.get("inverse", F.lit(i * d + j)) for i in range(d) for j in range(d)), F.lit(0.0))
    return ~F.col("m.base_failed") & F.coalesce(far <= CUT, F.lit(True))


def judged(docs: DataFrame, *keep: str) -> DataFrame:
    """row (the columns of docs that are named, or all), m (the statistics) and kept, for every row. Rows and statistics are
    written before the estimates are made, so texts are measured once."""
    small_batches(docs.sparkSession)
    row = F.struct(*(F.col(f"`{c}`") for c in keep or docs.columns))
    rows = stored(measured(docs, row), "measured")
    fits = estimates(rows.select("lang", "source", "m")).alias("e")
    joined = rows.alias("d").join(fits, F.expr("d.lang <=> e.lang and d.source <=> e.source"), "left")
    return joined.select("row", "m", _verdict().alias("kept"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents"), "doc_id")
    return out.select(F.col("row.doc_id").alias("doc_id"), *(F.col(f"m.{c}").alias(c) for c in COUNTS), F.col("m.base_failed").alias("base_failed"), "kept")
