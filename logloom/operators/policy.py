"""Rules on records: what disqualifies a row, what the audit counts, and what is done with a call's result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.gates import folded, may_have
from ..functions.redaction import names_found, plausible_ipv6
from ..functions.text import bound
from ..sources.storage import stored

PRESERVE, KEEP = 6, 0.5
TRUNCATED = 300
LEAST_CONTACTS = 3


def contacts(text: Column) -> Column:
    """Addresses and phone numbers in a text."""
    return sum((F.regexp_count(text, F.lit(P.regex(P.SECRETS[k]))) for k in ("email", "phone", "mobile")), F.lit(0))


def reason_of(text: Column, private: bool) -> Column:
    """Why a text disqualifies its row; null if it does not. The first rule that holds gives the reason."""

    def rules(x: Column) -> Column:
        text, low = x["text"], x["low"]
        topic = F.when(may_have("topic", low), F.nullif(F.lower(F.regexp_extract(text, P.regex(P.SENSITIVE), 1)), F.lit("")))
        out = [topic, *(F.when(may_have(name, low) & text.rlike(P.regex(p)), F.lit(name)) for name, p in P.DROP_ROWS.items())]
        if private:
            out.append(F.when(may_have("private context", low) & text.rlike(P.regex(P.PRIVATE_READ)), F.lit("private context")))
        return F.coalesce(*out, F.when((may_have("email", low) | may_have("phone", low)) & (contacts(text) >= LEAST_CONTACTS), F.lit("contact list")))

    return bound(F.struct(text.alias("text"), folded(text).alias("low")), rules)


def disqualify(fields: Column) -> Column:
    """The reason of the first of goal, said, input and result that has one; the empty text if none has."""
    return F.coalesce(*(reason_of(F.coalesce(fields[f], F.lit("")), f in ("input", "result")) for f in ("goal", "said", "input", "result")), F.lit(""))


def found_by(detector: str, text: Column, low: Column) -> Column:
    """What a detector finds in a text that was folded to `low`."""
    none = F.array().cast("array<string>")
    if detector == "ipv6 address":
        finds = F.filter(F.regexp_extract_all(text, F.lit(P.regex(P.IPV6)), F.lit(0)), plausible_ipv6)
    else:
        finds = F.regexp_extract_all(text, F.lit(P.regex(P.AUDIT[detector])), F.lit(0))
    return F.when(may_have(detector, low), finds).otherwise(none)


def audit(strings: DataFrame, samples: int = 4, names: list[str] | None = None) -> DataFrame:
    """strings(id, value): detector, n and its first samples, for each detector that found something; names(caller's list)
    count under "name: ...". Finds are kept in a table, so each text is read once, with its counts and a few samples."""

    def finds(x: Column) -> Column:
        rows = [F.struct(F.lit(d).alias("detector"), found_by(d, x["value"], x["low"]).alias("found")) for d in (*P.AUDIT, "ipv6 address")]
        return F.filter(F.array(*rows), lambda r: F.size(r["found"]) > 0)

    own = bound(F.struct("value", folded(F.col("value")).alias("low")), finds)
    if names:
        by_name = lambda found: F.transform(F.array_distinct(found), lambda n: F.struct(F.concat(F.lit("name: "), n).alias("detector"), F.filter(found, lambda m: m == n).alias("found")))
        own = F.concat(own, bound(names_found(F.col("value"), names), by_name))
    rows = strings.where("value is not null").select("id", F.explode(own).alias("x")).select("id", "x.detector", F.size("x.found").alias("n"), F.slice("x.found", 1, samples).alias("found"))
    rows = stored(rows, "finds")
    counts = rows.groupBy("detector").agg(F.sum("n").alias("n"))
    # the samples are the least (id, place); each group gives its few, so nothing grows with the number of finds
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("detector").orderBy("id", "found"))).where(F.col("rank") <= samples)
    first = first.select("detector", "id", F.posexplode("found").alias("place", "sample")).withColumn("rank", F.row_number().over(Window.partitionBy("detector").orderBy("id", "place", "sample"))).where(F.col("rank") <= samples)
    lists = first.groupBy("detector").agg(F.array_sort(F.collect_list(F.struct("rank", "sample"))).alias("x")).select("detector", F.col("x.sample").alias("samples"))
    return counts.join(lists, "detector")


def should_have_gone(rows: DataFrame, state: Column) -> DataFrame:
    """reason, n, sample: the rows whose state disqualifies them, and the least of each reason as JSON (160 characters)."""
    shown = F.left(F.to_json(state), F.lit(160))
    out = rows.select(disqualify(state).alias("reason"), shown.alias("sample")).where("reason <> ''")
    return out.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min("sample").alias("sample"))


def verdict(counts: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """One row: code 0 if no detector or name found anything and no row should have gone, else 2."""
    all_counts = counts.select("n") if gone is None else counts.select("n").unionByName(gone.select("n"))
    return all_counts.agg(F.when(F.coalesce(F.sum("n"), F.lit(0)) == 0, 0).otherwise(2).alias("code"))


def decide(score: Column, call_score: Column, tool: Column, keep: float = KEEP, drop_calls: Column | bool = True, protect: bool = True) -> Column:
    """keep, truncate or drop. A result that cannot be had again is never dropped under protection; a null score is 0."""
    score, call_score = F.coalesce(score, F.lit(0.0)), F.coalesce(call_score, F.lit(0.0))
    drop_calls = drop_calls if isinstance(drop_calls, Column) else F.lit(drop_calls)
    return F.when(score >= keep, "keep").when(F.lit(protect) & ~tool.isin(P.REPRODUCIBLE), "truncate").when(~drop_calls | (call_score >= keep), "truncate").otherwise("drop")


def retained(action: Column, size: Column) -> Column:
    return F.when(action == "keep", size).when(action == "truncate", F.lit(TRUNCATED)).otherwise(0)


def too_old(order: list[str], partition: str, preserve: int = PRESERVE) -> Column:
    """Whether the baseline drops a call: all but the newest few go."""
    return F.row_number().over(Window.partitionBy(partition).orderBy(*(F.col(c).desc() for c in order))) > preserve
