"""Which tokens of an output are used later, and where from.

A use is containment in a later event. Tokens are runs of one character class, so each lies within a run of the event;
distinct runs and tokens meet by 8-character pieces in an equi-join and are then verified, so no token is tried on every
event, and a run that many events have is taken apart once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import distinctive_tokens

PIECE = 8


def grams(run: Column, width: int) -> Column:
    """Every `width` characters in a row, in their order; none of a shorter run."""
    return F.regexp_extract_all(run, F.lit(f"(?s)(?=(.{{{width}}}))"), F.lit(1))


def containing(needles: DataFrame, runs: DataFrame, widths: tuple[int, ...] = (PIECE,)) -> DataFrame:
    """needles(needle), of widths[0] characters or more, and runs(run): needle, run for each distinct pair of which the run
    contains the needle. They meet by the needle's first characters, as many as the largest of the widths that it has;
    then they are verified."""
    first = F.left("needle", F.lit(widths[0]))
    for w in widths[1:]:
        first = F.when(F.length("needle") >= w, F.left("needle", F.lit(w))).otherwise(first)
    wanted = needles.select("needle").distinct().withColumn("key", first)
    runs = runs.select("run").distinct()
    keys = runs.select("run", F.explode(F.array_distinct(F.concat(*(grams(F.col("run"), w) for w in widths)))).alias("key"))
    return wanted.hint("merge").join(keys.hint("merge"), "key").where(F.contains("run", F.col("needle"))).select("needle", "run")


def occurrences(tokens: DataFrame, events: DataFrame) -> DataFrame:
    """tokens(session, token), events(session, pos, kind, body): session, token, pos, kind for each event that contains the
    token. Distinct tokens of a session are looked for once. A token is not letters alone, so neither is its run."""
    wanted = tokens.select("session", "token").distinct()
    runs = events.select("session", "pos", "kind", F.explode(F.array_distinct(distinctive_tokens(F.col("body")))).alias("run"))
    return met(wanted, runs, "pos", "kind").distinct()


def met(wanted: DataFrame, runs: DataFrame, *more: str) -> DataFrame:
    """wanted(session, token), distinct, and runs(session, run, ...): session, token and the columns named, for each run that
    contains the token. Tokens are looked for in the distinct runs; the sessions that have both come after."""
    held = containing(wanted.select(F.col("token").alias("needle")), runs.select("run")).withColumnRenamed("needle", "token")
    asked = wanted.hint("merge").join(held, "token")
    return runs.hint("merge").join(asked.hint("merge"), ["session", "run"]).select("session", "token", *more)


def classified(tokens: DataFrame, found: DataFrame, *more: str, until: str = "now") -> DataFrame:
    """tokens(session, token, start, now, and the columns named) and their occurrences: use and proven. The first use by the
    agent from `now` on decides: own if the agent had used it in [start, until), else recarried if a tool event in [start, first
    use) had it, else fresh; null if it is never used. proven: whether the agent used it in [start, until).

    A token's rows and occurrences stand in one order, from which each row takes the next occurrence: a token that many rows
    and many events have costs their sum, not their product."""
    key = list(dict.fromkeys(["session", "token", "start", "now", until, *more]))
    looks = F.explode(F.array(F.struct(F.col("start").cast("long").alias("at"), F.lit(1).alias("look")), F.struct(F.col("now").cast("long").alias("at"), F.lit(2).alias("look"))))
    rows = tokens.select(*key, looks.alias("x")).select(*key, "x.at", "x.look")
    seen = found.select("session", "token", F.col("pos").cast("long").alias("at"), F.lit(0).alias("look"), *(F.when(F.col("kind") == k, F.col("pos").cast("long")).alias(k) for k in ("agent", "tool")))
    w = Window.partitionBy("session", "token").orderBy(F.col("at").desc(), "look").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.unionByName(seen, allowMissingColumns=True).withColumns({"agent": F.min("agent").over(w), "tool": F.min("tool").over(w)}).where("look > 0")
    of = lambda look, c: F.max(F.when(F.col("look") == look, F.col(c)))
    marks = rows.groupBy(*key).agg(of(2, "agent").alias("first"), of(1, "agent").alias("mine"), of(1, "tool").alias("tool"))
    own = F.coalesce(F.col("mine") < F.col(until), F.lit(False))
    return marks.select(*key, use_kind(F.col("first"), own, F.col("tool")).alias("use"), own.alias("proven"))


def use_kind(first: Column, own: Column, tool: Column) -> Column:
    return F.when(first.isNull(), F.lit(None)).when(own, "own").when(tool < first, "recarried").otherwise("fresh")
