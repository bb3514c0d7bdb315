"""Text functions on Columns: lines, tokens, previews, clipping, replacement by a function, greedy filling of a budget.

Lengths count code points. Nulls give nulls unless a function says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends: \r\n, and each of \n \r \v \f \x1c-\x1e \x85 U+2028 U+2029.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"
TOKEN = r"[\p{L}\p{N}_./:@-]{8,}"
WORD = r"[\p{L}\p{N}_./:@-]{4,}"
#: White space as str.split() has it.
SPACE = r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
NO_SPACE = SPACE.replace("[", "[^")
HEAD, TAIL = 600, 200
CHUNK_LINES, MOST_CHUNKS = 15, 24


def split_lines(text: Column) -> Column:
    """The lines, without an empty one behind the last line end; the empty text has none."""
    return bound(F.split(text, LINE_END, -1), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def collapse_space(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"{SPACE}+", " "), "^ | $", "")


def strip(text: Column) -> Column:
    ends = F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1)))
    return F.when(ends.rlike(SPACE), F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")).otherwise(text)


def blank(text: Column) -> Column:
    """Whether a text has nothing but white space."""
    return ~text.rlike(NO_SPACE)


def distinctive_tokens(text: Column, known: Column | None = None) -> Column:
    """Runs of 8 or more word characters and ./:@- that are not letters alone and don't occur in what was known."""
    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    if known is None:
        return F.filter(found, lambda t: ~t.rlike(r"^\p{L}+$"))
    return F.filter(found, lambda t: ~t.rlike(r"^\p{L}+$") & ~F.contains(known, t))


def overlap_words(text: Column) -> Column:
    """Distinct lower-cased words of 4 or more characters."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def edge_distance(i: Column, n: Column) -> Column:
    """How far line i of n is from the nearer end."""
    return F.least(i, n - 1 - i)


def preview(text: Column, head: int = HEAD, tail: int = TAIL) -> Column:
    """Both ends of a text and how much stands between; a text of head + tail + 40 characters or fewer stays."""
    n = F.length(text)
    cut = F.concat(F.left(text, F.lit(head)), F.format_string("\n[... %d chars ...]\n", n - head - tail), F.right(text, F.lit(tail)))
    return F.when(n <= head + tail + 40, text).otherwise(cut)


def head_tail(text: Column, budget: Column) -> Column:
    """Both ends of a text, 70 % of the budget at its head; the mark between them comes on top. With budget 0 the mark is
    followed by the whole text."""
    head = F.floor(budget * 0.7).cast("int")
    tail = F.when(budget == 0, text).otherwise(F.right(text, budget - head))
    return F.when(F.length(text) <= budget, text).otherwise(F.concat(F.left(text, head), F.lit("\n[...]\n"), tail))


def chunks(text: Column, lines: int = CHUNK_LINES, most: int = MOST_CHUNKS) -> Column:
    """Consecutive lines in `most` pieces at the most, of at least `lines` lines."""


    def cut(all_lines: Column) -> Column:
        n = F.size(all_lines)
        step = F.greatest(F.lit(lines), F.ceil(n / most).cast("int"))
        starts = F.when(n > 0, F.sequence(F.lit(1), n, step)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.array_join(F.slice(all_lines, s, step), "\n"))

    return bound(split_lines(text), cut)


def strip_line_numbers(text: Column, tool: Column) -> Column:
    """Read's numbered lines without their numbers; other tools' texts as they are."""
    return F.when(tool == "Read", F.regexp_replace(text, r"(?md)^\s*\d+\t", "")).otherwise(text)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """A function of a value that is computed once, however often the function names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def replace_by(text: Column, pattern: str, replacement: Callable[[Column], Column]) -> Column:
    """Each match replaced by a function of it."""

    def pieces(t: Column) -> Column:
        between, found = F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        return F.array_join(F.zip_with(between, found, lambda s, m: F.concat(s, F.coalesce(replacement(m), F.lit("")))), "")

    return bound(text, pieces)


def fill_budget(ranked: Column, budget: Column) -> Column:
    """ranked: array of structs (..., i, size) in the order of preference. The i of those that fit: one that does not fit
    is passed over, and the next is tried. Each costs its size and one more."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        cost = acc["used"] + x["size"] + 1
        return F.when(cost <= budget, F.struct(cost.alias("used"), F.array_append(acc["kept"], x["i"]).alias("kept"))).otherwise(acc)

    return F.aggregate(ranked, start, step, lambda acc: acc["kept"])


def kept_text(lines: Column, kept: Column) -> Column:
    """The lines with the given numbers (from 0), in their own order."""
    return F.array_join(F.transform(F.array_sort(kept), lambda i: F.get(lines, i)), "\n")


def base_name(target: Column) -> Column:
    """What follows the last slash of a target's first word; the empty text where there is none."""
    first = F.element_at(F.split(strip(target), f"{SPACE}+"), 1)
    return F.coalesce(F.element_at(F.split(first, "/"), -1), F.lit(""))
