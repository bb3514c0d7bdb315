"""Operator 10: line dedup by site-relative frequency.

Pages are grouped by host. A line (trimmed, not empty) is boilerplate of a host if the share of the host's pages that
have it exceeds RATIO; hosts with fewer than LEAST_PAGES pages have none. Boilerplate lines go; a page that would lose
all its lines stays as it is, for it is then a copy rather than a frame around content.

Pages count once a line, so each page gives its distinct lines, and counts are combined before the shuffle. A host has at
most its mean number of lines over RATIO such lines, whatever its size; they are joined to its pages as one array, and a
hot host's pages need not meet in a task.

Documents come in few, large sources, in which no line fills half. `framed` takes the lines that many different texts have,
in a source or in all, for the pipeline. A document that consists mostly of such lines is a copy of others; it stays whole
and is left to near-dedup.

Defined results: null and empty texts have no lines and stay; a null host is a host of its own; repeated pages count
each; very long pages are read whole; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

RATIO, LEAST_PAGES = 0.5, 3
#: For documents: a line goes if LEAST_TEXTS different texts have it, and more than a share of its source's or of all.
LEAST_TEXTS, SOURCE_RATIO, WHOLE_RATIO = 10, 0.01, 0.001
#: A document that would keep a smaller share of its characters stays as it is.
LEAST_KEPT = 0.5
#: Where a web page's text breaks: at tags and line ends.
BREAKS = r"(<[^>]*>|[\r\n])+"
BLANK = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
SPACE = " \t\n\x0b\x0c\r"
KEYS = "array<struct<a:bigint,b:bigint>>"


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE))


def _key(line: Column) -> Column:
    """128 bits that stand for a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def _bound(value: Column, body) -> Column:
    """A function of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _marked(lines: Column, *lists: Column) -> Column:
    """The lines as structs: line, full (not empty when trimmed), gone (its key is in one of the lists of keys). Most lines are
    told by the first half of their key alone, which is compared as a number."""
    firsts = F.struct(*(F.transform(x, lambda k: k["a"]).alias(f"x{i}") for i, x in enumerate(lists)))

    def hit(t: Column, heads: Column) -> Column:
        a = F.xxhash64(t)
        out = F.lit(False)
        for i, x in enumerate(lists):
            out = out | (F.array_contains(heads[f"x{i}"], a) & F.array_contains(x, _key(t)))
        return out

    one = lambda x, heads: _bound(trimmed(x), lambda t: F.struct(x.alias("line"), (t != "").alias("full"), ((t != "") & hit(t, heads)).alias("gone")))
    return _bound(firsts, lambda heads: F.transform(lines, lambda x: one(x, heads)))


def boilerplate(pages: DataFrame) -> DataFrame:
    """pages(host, lines). Returns host, host_pages, keys (of its boilerplate lines)."""
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    own = F.array_distinct(F.filter(F.transform("lines", trimmed), lambda x: x != ""))
    counts = pages.select("host", F.explode(own).alias("line")).select("host", _key(F.col("line")).alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"))
    often = counts.alias("c").join(totals.alias("t"), F.expr("c.host <=> t.host")).where((F.col("host_pages") >= LEAST_PAGES) & (F.col("n") > RATIO * F.col("host_pages")))
    keys = often.groupBy(F.col("t.host").alias("host")).agg(F.collect_list("key").alias("keys"))
    out = totals.alias("t").join(keys.alias("k"), F.expr("t.host <=> k.host"), "left")
    return stored(out.select("t.host", "host_pages", F.coalesce("keys", F.array().cast(KEYS)).alias("keys")), "boilerplate")


def repeated(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs(host, lines, text). Returns host, keys (of lines repeated in it), and one row of keys (of lines repeated in all
    documents). Copies of a text count once. By the shares, neither has more keys than its mean number of lines over them."""
    own = F.array_distinct(F.filter(F.transform("lines", trimmed), lambda x: x != ""))
    prints = docs.select("host", "lines", F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b")).alias("text"))
    hosts, whole = prints.groupBy("host").agg(F.countDistinct("text").alias("of")), prints.agg(F.countDistinct("text").alias("of"))
    seen = stored(prints.select("host", "text", F.explode(own).alias("line")).select("host", "text", _key(F.col("line")).alias("key")).distinct(), "seen")
    often = lambda share: F.expr(f"n >= {LEAST_TEXTS} and n > {share} * of")
    near = seen.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {LEAST_TEXTS}").alias("s").join(F.broadcast(hosts.alias("h")), F.expr("s.host <=> h.host")).where(often(SOURCE_RATIO))
    everywhere = seen.select("text", "key").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {LEAST_TEXTS}").crossJoin(F.broadcast(whole)).where(often(WHOLE_RATIO))
    return stored(near.groupBy(F.col("s.host").alias("host")).agg(F.collect_list("key").alias("keys")), "repeated"), stored(everywhere.agg(F.collect_list("key").alias("everywhere")), "everywhere")


def framed(docs: DataFrame) -> DataFrame:
    """docs(row, host, lines, text). Returns row, n_dropped and kept: the lines that are not repeated in many documents."""
    near, everywhere = repeated(docs.select("host", "lines", "text"))
    rows = docs.alias("p").join(near.alias("b"), F.expr("p.host <=> b.host"), "left").crossJoin(F.broadcast(everywhere)).select("p.row", "p.lines", F.coalesce("b.keys", F.array().cast(KEYS)).alias("keys"), "everywhere")
    rows = rows.select("row", _bound(_marked(F.col("lines"), F.col("everywhere"), F.col("keys")), _without_frame).alias("out"))
    return rows.select("row", "out.n_dropped", "out.kept")


def _without_frame(marked: Column) -> Column:
    """n_dropped and kept of a document's marked lines; of a copy nothing goes."""
    size = lambda rows: F.aggregate(rows, F.lit(0), lambda n, x: n + F.length(trimmed(x["line"])))

    def outcome(stay: Column) -> Column:
        copy = size(stay) < LEAST_KEPT * size(marked)
        kept = F.transform(F.when(copy, marked).otherwise(stay), lambda x: x["line"])
        return F.struct(F.when(copy, 0).otherwise(F.size(marked) - F.size(stay)).alias("n_dropped"), kept.alias("kept"))

    return _bound(F.filter(marked, lambda x: ~x["gone"]), outcome)


def cleaned(pages: DataFrame) -> DataFrame:
    """pages(row, host, lines). Returns row, host, host_pages, n_lines, n_dropped (both of lines that aren't empty), and
    kept: the lines that stay."""
    found = boilerplate(pages.select("host", "lines")).alias("b")
    rows = pages.alias("p").join(found, F.expr("p.host <=> b.host"), "left").select("p.row", "p.host", "host_pages", "keys", "p.lines")
    full = lambda m: F.size(F.filter(m, lambda x: x["full"]))

    def outcome(m: Column) -> Column:
        stay = F.filter(m, lambda x: ~x["gone"])
        whole = full(stay) == 0
        kept = F.transform(F.when(whole, m).otherwise(stay), lambda x: x["line"])
        return F.struct(full(m).alias("n_lines"), F.when(whole, 0).otherwise(F.size(m) - F.size(stay)).alias("n_dropped"), kept.alias("kept"))

    rows = rows.select("row", "host", "host_pages", _bound(_marked(F.col("lines"), F.col("keys")), outcome).alias("out"))
    return rows.select("row", "host", "host_pages", "out.n_lines", "out.n_dropped", "out.kept")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page of `pages`: its host, how many of its text lines went, and the lines that stay, joined by line breaks."""
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))
    pages = table(spark, sf_dir, "pages").select(F.struct("page_id").alias("row"), host.alias("host"), F.split(F.coalesce("html", F.lit("")), BREAKS).alias("lines"))
    pages = pages.withColumn("lines", F.filter(F.transform("lines", trimmed), lambda x: x != ""))
    return cleaned(pages).select("row.page_id", "host", "host_pages", "n_lines", "n_dropped", F.array_join("kept", "\n").alias("text"))


OP10_SQL = rf"""
with pages_lines as (
  select page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)) as host,
         list_filter(list_transform(regexp_split_to_array(coalesce(html, ''), '{BREAKS}'), lambda x: regexp_replace(x, '{BLANK}', '', 'g')), lambda x: x <> '') as lines
  from pages),
totals as (select host, count(*) as host_pages from pages_lines group by host),
counts as (select host, line, count(*) as n from (select host, unnest(list_distinct(lines)) as line from pages_lines) group by host, line),
keys as (
  select c.host, list(line) as keys from counts c join totals t on c.host is not distinct from t.host
  where host_pages >= {LEAST_PAGES} and n > {RATIO} * host_pages group by c.host),
kept as (
  select page_id, p.host, host_pages, lines, list_filter(lines, lambda x: not list_contains(coalesce(keys, []), x)) as stay
  from pages_lines p join totals t on p.host is not distinct from t.host left join keys k on p.host is not distinct from k.host)
select page_id, host, host_pages, cast(len(lines) as integer) as n_lines,
       cast(case when len(stay) = 0 then 0 else len(lines) - len(stay) end as integer) as n_dropped,
       array_to_string(case when len(stay) = 0 then lines else stay end, chr(10)) as text
from kept
"""
