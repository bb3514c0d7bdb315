r"""Operator 9: benchmark decontamination, in DataFrame and SQL functions only.

A window is as many consecutive words of a document as a benchmark item has. It leaks the item if the weighted similarity
of their 5-word shingles (sum of the smaller over sum of the larger counts) is 0.8 or more. Shorter items have one
shingle, the whole.

1. Seeds. Such a window shares shingles with its item. Windows that line up a shingle with an item's are looked at, and so
   are all others that have as many shingles of an item, in any places, as a similarity of 0.8 takes (a passage with its
   halves swapped lines up nothing), so nothing is lost. Where the benchmark has at most INLINE shingles (checked),
   documents are searched for their hashes in place. A larger benchmark is joined by hash instead.
2. Fingerprints. Distinct windows and items get SimHash fingerprints of their shingles, of PARTS times 63 bits, in BLOCKS
   blocks of 15 or 16 bits. Two that differ in RADIUS bits or fewer differ in NEAR or fewer in one block at least. Items
   stand under every value within NEAR bits of their blocks, windows ask with their own, so the join on length, block
   and value misses none of them, and of other pairs it lets about one in eight meet. A similarity of 0.8 is an angle of
   0.15 half-turns, about 29 bits of 189; RADIUS lies 3.7 standard deviations beyond.
3. Verification of the exact similarity.

Defined results: null texts are empty; a document shorter than an item is one window; null doc_ids are reported as null;
rows that repeat a doc_id are looked at each and reported together; items without words are never leaked; ties go to the
smaller start; very long texts are searched whole; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

SHINGLE, LEAST = 5, 0.8
PARTS, BLOCKS, NEAR = 3, 12, 3
RADIUS = BLOCKS * (NEAR + 1) - 1
#: A bit in each of three lanes of 21 bits, in which bits are counted; a lane's largest count.
LANES, LANE_BITS = 1 | 1 << 21 | 1 << 42, 21
#: Most benchmark shingles that are searched for in place, and most that are broadcast.
INLINE, BROADCAST = 50_000, 1_000_000
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0))


def _hash(words: str, at: str, n: int) -> str:
    """SQL for the hash of n words from a place on."""
    return f"xxhash64({', '.join(f'get({words}, {at} + {i})' for i in range(n))})"


def _places(words: str, n: int) -> str:
    """SQL for the places where n words start."""
    return f"if(size({words}) >= {n}, sequence(0, size({words}) - {n}), cast(array() as array<int>))"


def _shingles(words: str, n: str = str(SHINGLE)) -> Column:
    """The shingles, as strings; of fewer words, the whole."""
    return F.expr(f"if(size({words}) > {n}, transform(sequence(1, size({words}) - {n} + 1), i -> array_join(slice({words}, i, {n}), ' ')), array(array_join({words}, ' ')))")


def _fingerprint(shingles: str) -> Column:
    """PARTS numbers of 63 bits. A bit is set if it is in over half of the shingles' hashes. Three bits are counted at once: a
    hash that is shifted and masked has one in each lane, and a count over half carries into its lane's last place."""
    counted = f"aggregate(h, 0L, (s, x) -> s + (shiftrightunsigned(x, j) & {LANES}L))"
    half = f"({(1 << LANE_BITS - 1) - 1}L - cast(size(h) div 2 as bigint)) * {LANES}L"
    part = f"aggregate(sequence(0, {LANE_BITS - 1}), 0L, (f, j) -> f | shiftleft(shiftrightunsigned({counted} + {half}, {LANE_BITS - 1}) & {LANES}L, j))"
    return F.expr("array(" + ", ".join(f"element_at(transform(array(transform({shingles}, x -> xxhash64({k}, x))), h -> {part}), 1)" for k in range(PARTS)) + ")")


def _blocks(fp: str) -> Column:
    """The blocks of a fingerprint: number, width and value."""
    each = BLOCKS // PARTS
    edges = [63 * k // each for k in range(each + 1)]
    out = [f"struct({p * each + k} as block, {b - a} as width, cast(shiftrightunsigned(get({fp}, {p}), {a}) & {(1 << b - a) - 1}L as int) as value)" for p in range(PARTS) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    return F.expr("array(" + ", ".join(out) + ")")


def _changes(spark: SparkSession) -> DataFrame:
    """width, change: every pattern of NEAR bits or fewer in a block of that width. About 1,300 rows."""
    rows = [(width, sum(1 << b for b in bits)) for width in (15, 16) for n in range(NEAR + 1) for bits in itertools.combinations(range(width), n)]
    return spark.createDataFrame(rows, "width int, change int")


def near(windows: DataFrame, items: DataFrame) -> DataFrame:
    """Both (n_words, fp), distinct: n_words, fp, item_fp of all pairs of a length within RADIUS bits."""
    asked = windows.select("n_words", "fp", F.inline(_blocks("fp"))).drop("width").alias("w")
    kept = items.select("n_words", "fp", F.inline(_blocks("fp"))).join(F.broadcast(_changes(items.sparkSession)), "width")
    kept = kept.select("n_words", "fp", "block", F.col("value").bitwiseXOR(F.col("change")).alias("value")).alias("t")
    apart = " + ".join(f"bit_count(get(w.fp, {p}) ^ get(t.fp, {p}))" for p in range(PARTS))
    met = asked.join(kept, F.expr(f"w.n_words = t.n_words and w.block = t.block and w.value = t.value and {apart} <= {RADIUS}"))
    return met.select("w.n_words", F.col("w.fp").alias("fp"), F.col("t.fp").alias("item_fp")).distinct()


def _similarity(a: str, b: str) -> Column:
    both = f"cast(aggregate(array_intersect({a}, {b}), 0, (n, s) -> n + least(size(filter({a}, x -> x = s)), size(filter({b}, x -> x = s)))) as double)"
    return F.expr(f"{both} / (size({a}) + size({b}) - {both})")


def windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, start, n_words, window, lined_up: every window that lines up a shingle with one of an item (item_id, words),
    and every other window that has enough of an item's shingles."""
    out = None
    sizes = [r.k for r in items.select(F.least(F.size("words"), F.lit(SHINGLE)).alias("k")).distinct().collect()]  # 1 to 5
    spread = docs.select("doc_id", words_of("text").alias("words"))
    for k in sizes:
        own = items.where(F.least(F.size("words"), F.lit(SHINGLE)) == k).select("item_id", "words", F.size("words").alias("n_words"), F.explode(F.expr(_places("words", k))).alias("at"))
        own = stored(own.withColumn("hash", F.expr(_hash("words", "at", k))).drop("words"), "seeds")
        n = own.count()
        # exploded as an expression: a filter on the array would be pushed below `words` and split the text for every place
        if n <= INLINE:
            wanted = ", ".join(f"{r['hash']}L" if r["hash"] > -(1 << 63) else "-9223372036854775807L - 1L" for r in own.select("hash").distinct().collect())
            places = f"filter({_places('words', k)}, i -> {_hash('words', 'i', k)} in ({wanted}))"
            met = spread.select("doc_id", "words", F.explode(F.expr(f"filter(array({places}), x -> size(x) > 0)")).alias("hits"))
        else:
            keys = own.select("hash").distinct()
            places = spread.select("doc_id", "words", F.explode(F.expr(_places("words", k))).alias("i")).withColumn("hash", F.expr(_hash("words", "i", k)))
            met = places.join(F.broadcast(keys) if n <= BROADCAST else keys, "hash", "left_semi").groupBy("doc_id", "words").agg(F.collect_set("i").alias("hits"))
        met = stored(met.withColumn("id", F.monotonically_increasing_id()), "met")
        hits = met.select("id", F.size("words").alias("size"), F.explode("hits").alias("i"), F.col("words").alias("w")).select("id", "size", "i", F.expr(_hash("w", "i", k)).alias("hash"))
        starts = hits.join(own.select("hash", "at", "n_words").distinct(), "hash").select("id", F.expr("greatest(0, least(i - at, size - n_words))").alias("start"), "n_words", F.lit(True).alias("lined_up"))
        if k == SHINGLE:  # shorter items have one shingle, which lines up
            starts = starts.unionByName(_shifted(hits, own))
        starts = stored(starts.groupBy("id", "start", "n_words").agg(F.bool_or("lined_up").alias("lined_up")), "starts")
        met = starts.join(met.drop("hits"), "id").select("doc_id", "start", "n_words", F.expr("slice(words, start + 1, n_words)").alias("window"), "lined_up")
        out = met if out is None else out.unionByName(met)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, start int, n_words int, window array<string>, lined_up boolean")
    return out.groupBy("doc_id", "start", "n_words", "window").agg(F.bool_or("lined_up").alias("lined_up"))


def _shifted(hits: DataFrame, own: DataFrame) -> DataFrame:
    """id, start, n_words, lined_up (false): the windows that have enough shingles of an item, in any order. Two sets of m
    shingles are similar if they share m * 2 * LEAST / (1 + LEAST) or more, so from the hit at j on, as many hits less one
    must follow before the window ends."""
    at = hits.join(own.select("item_id", "n_words", "hash").distinct(), "hash").where("size >= n_words")
    at = at.groupBy("id", "size", "item_id", "n_words").agg(F.array_sort(F.collect_set("i")).alias("p"))
    at = at.withColumn("m", F.expr(f"n_words - {SHINGLE - 1}")).withColumn("need", F.expr(f"cast(ceil(m * {2 * LEAST / (1 + LEAST)!r}D - 1e-6D) as int)"))
    runs = F.expr("filter(transform(sequence(0, size(p) - need), j -> struct(greatest(0, p[j + need - 1] - m + 1) as a, least(p[j], size - n_words) as b)), x -> x.a <= x.b)")
    starts = at.where("size(p) >= need").select("id", "n_words", F.explode(runs).alias("x")).select("id", F.explode(F.sequence("x.a", "x.b")).alias("start"), "n_words")
    return starts.distinct().withColumn("lined_up", F.lit(False))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word (start of the first leaking window), n_windows, similarity (the largest); of the windows
    that line up a shingle if one of them leaks, or else of all."""
    items = stored(benchmark.select(F.col("item_id").cast("long"), words_of("text").alias("words")).where(F.size("words") > 0), "items")
    found = stored(windows(docs.select(F.col("doc_id").cast("long"), "text"), items), "windows")

    def marked(frame: DataFrame) -> DataFrame:
        return frame.withColumn("shingles", _shingles("words")).withColumn("fp", _fingerprint("shingles"))

    own = stored(marked(found.select("n_words", F.col("window").alias("words")).distinct()), "contents")
    theirs = stored(marked(items.select("item_id", "words", F.size("words").alias("n_words"))), "marked")
    # fingerprints meet in blocks; what is within the radius gets its shingles back and is verified
    close = near(own.select("n_words", "fp").distinct(), theirs.select("n_words", "fp").distinct())
    pairs = close.join(own, ["n_words", "fp"]).select("n_words", "item_fp", F.col("words").alias("window"), F.col("shingles").alias("a"))
    pairs = pairs.join(theirs.select("item_id", "n_words", F.col("fp").alias("item_fp"), F.col("shingles").alias("b")), ["n_words", "item_fp"])
    same = stored(pairs.withColumn("similarity", _similarity("a", "b")).where(F.col("similarity") >= LEAST).select("n_words", "window", "item_id", "similarity"), "same")
    rows = found.join(same, ["n_words", "window"]).groupBy("doc_id", "item_id", "lined_up").agg(F.min("start").alias("first_word"), F.count(F.lit(1)).alias("n_windows"), F.max("similarity").alias("similarity"))
    first = rows.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("first_word", "n_windows", "similarity"), "lined_up").alias("of"))
    return first.select("doc_id", "item_id", "of.first_word", "of.n_windows", "of.similarity")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The same by exact similarity of every window that shares a shingle with an item of its length, without fingerprints.
OP9_SQL = rf"""
with split as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') as words from documents),
items as (select * from (select item_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') as words from benchmark) where len(words) > 0),
seeds as (select item_id, len(words) as n_words, least(len(words), {SHINGLE}) as k, unnest(range(0, len(words) - least(len(words), {SHINGLE}) + 1)) as pos, words from items),
keyed as (select n_words, k, pos, array_to_string(words[pos + 1 : pos + k], ' ') as shingle from seeds group by all),
kinds as (select distinct k from keyed),
places as (select doc_id, words, k, unnest(range(0, len(words) - k + 1)) as i from split, kinds where len(words) >= k),
hits as (select doc_id, words, k, i, array_to_string(words[i + 1 : i + k], ' ') as shingle from places),
met as (select doc_id, words, greatest(0, least(i - pos, len(words) - n_words)) as start, n_words from hits join keyed using (k, shingle)),
wins as (select distinct doc_id, start, n_words, words[start + 1 : start + n_words] as win from met),
pairs as (
  select doc_id, start, item_id, list_transform(range(0, greatest(1, len(win) - {SHINGLE} + 1)), lambda j: array_to_string(win[j + 1 : j + {SHINGLE}], ' ')) as a,
         list_transform(range(0, greatest(1, len(i.words) - {SHINGLE} + 1)), lambda j: array_to_string(i.words[j + 1 : j + {SHINGLE}], ' ')) as b
  from wins w join items i on len(i.words) = w.n_words),
common as (select *, cast(coalesce(list_sum(list_transform(list_intersect(a, b), lambda s: least(len(list_filter(a, lambda x: x = s)), len(list_filter(b, lambda x: x = s))))), 0) as double) as n_both from pairs),
scored as (select *, n_both / (len(a) + len(b) - n_both) as similarity from common)
select doc_id, item_id, cast(min(start) as integer) as first_word, count(*) as n_windows, max(similarity) as similarity
from scored where similarity >= {LEAST} group by doc_id, item_id
"""
