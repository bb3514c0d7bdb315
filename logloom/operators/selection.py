"""Cutting texts to a size: ranked lines under a budget, thresholds on chunks and lines, and what survives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import blank, bound, edge_distance, fill_budget, split_lines

SIZES = (0.74, 0.54, 0.32)
SMALL_SIZES = (0.54, 0.32, 0.15)


def ranked(lines: Column, scores: Column) -> Column:
    """Lines by falling score, nearer ends first among equals, then by number: structs of rank, i and size."""

    def rows(zipped: Column) -> Column:
        n = F.size(zipped)
        return F.transform(zipped, lambda x, i: F.struct((-x["score"]).alias("score"), edge_distance(i, n).alias("edge"), i.alias("i"), F.length(x["line"]).alias("size")))

    return F.array_sort(bound(F.arrays_zip(lines.alias("line"), scores.alias("score")), rows))


def select_lines(text: Column, score: Callable[[Column], Column], share: float) -> Column:
    """Numbers of the lines that fit into a share of the text, in order of preference. `score` gives the scores of lines."""
    return bound(split_lines(text), lambda lines: fill_budget(ranked(lines, score(lines)), F.length(text) * F.lit(share)))


def trim_chunks(pieces: Column, scores: Column, keep: float) -> Column:
    """Pieces with that score, joined; what went is told in a line at the end."""
    good = lambda x: F.coalesce(x["score"], F.lit(0.0)) >= keep

    def trimmed(zipped: Column) -> Column:
        kept = F.transform(F.filter(zipped, good), lambda x: x["piece"])
        dropped = F.aggregate(F.filter(zipped, lambda x: ~good(x)), F.lit(0), lambda a, x: a + F.length(x["piece"]))
        note = lambda n: F.array(F.format_string("[%d chars of this output were trimmed; re-run to see all of it]", n))
        return F.array_join(bound(dropped, lambda n: F.when(n > 0, F.concat(kept, note(n))).otherwise(kept)), "\n")

    return bound(F.arrays_zip(pieces.alias("piece"), scores.alias("score")), trimmed)


def prune_lines(lines: Column, scores: Column, threshold: float, least_chars: int = 18) -> Column:
    """Lines with that score; a single line between two that are kept stays. A run of others becomes a note of its length
    if it has more than `least_chars` characters, else it stays as it is; a run at the end is always a note. Blank
    lines belong to runs."""
    flags = F.transform(scores, lambda s: F.coalesce(s >= threshold, F.lit(False)))

    def marked(x: Column) -> Column:
        """The lines, each with whether it is kept."""
        at = lambda i: F.coalesce(F.get(x["good"], i), F.lit(False))
        return F.transform(x["lines"], lambda line, i: F.struct(line.alias("line"), (~blank(line) & (at(i) | (at(i - 1) & at(i + 1) & (i > 0)))).alias("keep")))

    def step(acc: Column, x: Column) -> Column:
        note = F.when(acc["chars"] > least_chars, F.array(F.format_string("(filtered %d lines)", F.size(acc["gap"])))).otherwise(acc["gap"])
        kept = F.struct(F.array_append(F.concat(acc["out"], note), x["line"]).alias("out"), none.alias("gap"), F.lit(0).alias("chars"))
        gone = F.struct(acc["out"].alias("out"), F.array_append(acc["gap"], x["line"]).alias("gap"), (acc["chars"] + F.length(x["line"])).alias("chars"))
        return F.when(x["keep"], kept).otherwise(gone)

    none = F.array().cast("array<string>")
    start = F.struct(none.alias("out"), none.alias("gap"), F.lit(0).alias("chars"))
    last = lambda acc: F.when(F.size(acc["gap"]) > 0, F.array_append(acc["out"], F.format_string("(filtered %d lines)", F.size(acc["gap"])))).otherwise(acc["out"])
    whole = bound(F.struct(lines.alias("lines"), flags.alias("good")), marked)
    return F.array_join(F.aggregate(whole, start, step, last), "\n")
