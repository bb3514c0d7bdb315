"""How well rules keep the lines of long outputs that are needed later, by why they are needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound, chunks, distinctive_tokens, fill_budget, head_tail, split_lines, strip, strip_line_numbers
from ..sources.storage import stored
from . import selection, sessions, usage

LONG = 4000
DEFINITIONS = ("all uses", "not own", "not own/recarried")


def long_outputs(calls: DataFrame, least: int = LONG) -> DataFrame:
    """Successful outputs of Bash and Read with that many characters."""
    return calls.where(_is_long(least))


def jobs(calls: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """session_id, call_pos, k, start, cut: each long output with each decision point k calls later that has a call behind it.
    Events from start on follow the output; those from cut on follow the decision point."""
    own = calls.select("session_id", "call_pos", sessions.call_event().alias("at"), _is_long().alias("long"))
    w = Window.partitionBy("session_id").orderBy("call_pos")
    points = {f"k{k}": F.when(F.lead("call_pos", k + 1).over(w).isNotNull(), F.lead("at", k).over(w)) for k in ks}
    own = own.withColumns(points).where("long")
    own = own.select("session_id", "call_pos", "at", F.inline(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("at_now")) for k in ks)))).where("at_now is not null")
    return own.select("session_id", "call_pos", "k", (F.col("at") + 2).alias("start"), (F.col("at_now") + 1).alias("cut"))


def _is_long(least: int = LONG) -> Column:
    return F.col("tool").isin("Bash", "Read") & ~F.col("is_error") & (F.length("result") >= least)


def _body() -> Column:
    return strip_line_numbers(F.col("result"), F.col("tool"))


def needed_lines(calls: DataFrame, texts: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """The lines of the jobs that are used after the decision point or were used before it: session_id, call_pos, k, line_no, kind
    (fresh over recarried over own; null if not used later), proven. Of bodies only tokens leave their rows."""
    known = F.concat("input_json", "narration")
    lines = long_outputs(calls).select("session_id", "call_pos", known.alias("known"), F.posexplode(split_lines(_body())).alias("line_no", "line"))
    tokens = lines.select(F.col("session_id").alias("session"), "call_pos", "line_no", F.explode(F.array_distinct(distinctive_tokens(F.col("line"), F.col("known")))).alias("token"))
    tokens = stored(tokens, "tokens")
    points = jobs(calls, ks).select(F.col("session_id").alias("session"), "call_pos", "k", "start", F.col("cut").alias("now"))
    wanted = tokens.hint("merge").join(points, ["session", "call_pos"])
    events = sessions.events(calls, texts).select(F.col("session_id").alias("session"), "pos", "kind", F.explode(F.array_distinct(distinctive_tokens(F.col("body")))).alias("run"))
    found = usage.met(tokens.select("session", "token").distinct(), events, "pos", "kind")
    marks = usage.classified(wanted, found, "call_pos", "k", "line_no").where("use is not null or proven")
    rank = F.max(F.when(F.col("use") == "fresh", 3).when(F.col("use") == "recarried", 2).when(F.col("use") == "own", 1))
    out = marks.groupBy("session", "call_pos", "k", "line_no").agg(rank.alias("r"), F.bool_or("proven").alias("proven"))
    kind = F.when(F.col("r") == 3, "fresh").when(F.col("r") == 2, "recarried").when(F.col("r") == 1, "own")
    return out.select(F.col("session").alias("session_id"), "call_pos", "k", "line_no", kind.alias("kind"), "proven")


def cuts(calls: DataFrame, texts: DataFrame, ks: tuple[int, ...], shares: tuple[float, ...]) -> DataFrame:
    """session_id, call_pos, k, share, line_no, line, kind, by_ends, by_hindsight: for each needed line, whether a cut to
    that share of the output keeps it: one to both ends (by its text), and one that prefers lines of which something was
    used before the decision point (by its number). An output meets all its decision points at once."""
    by = ["session_id", "call_pos"]
    lists = needed_lines(calls, texts, ks).groupBy(*by, "k").agg(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("line_no", "kind"))).alias("needed"), F.collect_list(F.when(F.col("proven"), F.col("line_no"))).alias("proven"))
    points = stored(lists.where(F.size("needed") > 0).groupBy(*by).agg(F.collect_list(F.struct("k", "needed", "proven")).alias("points")), "lines")
    bodies = long_outputs(calls).select(*by, _body().alias("body"))
    rows = bodies.hint("merge").join(points, by).select(*by, "body", F.inline("points"))
    # behind an explode, lines and their ranks are computed once for all shares
    rows = rows.select(*by, "k", "body", "needed", "proven", F.explode(F.array(split_lines(F.col("body")))).alias("lines"))
    scores = F.transform("lines", lambda x, i: F.array_contains("proven", i).cast("int"))
    rows = rows.select(*by, "k", "body", "needed", "lines", F.explode(F.array(selection.ranked(F.col("lines"), scores))).alias("ranked"))
    rows = rows.select("*", F.explode(F.array(*map(F.lit, shares))).alias("share"))
    kept = fill_budget(F.col("ranked"), F.length("body") * F.col("share"))
    ends = head_tail(F.col("body"), F.floor(F.length("body") * F.col("share")).cast("int"))
    rows = rows.select(*by, "k", "share", kept.alias("kept"), ends.alias("ends"), "lines", "needed")
    rows = rows.select(*by, "k", "share", "kept", "ends", "lines", F.inline("needed"))
    line = F.get("lines", F.col("line_no"))
    return rows.select(*by, "k", "share", "line_no", line.alias("line"), "kind", F.contains("ends", line).alias("by_ends"), F.array_contains("kept", F.col("line_no")).alias("by_hindsight"))


def matrix(rows: DataFrame) -> DataFrame:
    """k, definition, share, needed, by_ends, by_hindsight: sums over the needed lines of each definition (each holds in the
    one before)."""
    kinds = {"fresh": 3, "recarried": 2, "own": 1}
    holds = F.array(*(F.when(F.col("kind").isin([k for k, n in kinds.items() if n > i]), F.lit(d)) for i, d in enumerate(DEFINITIONS)))
    own = rows.select("k", "share", "by_ends", "by_hindsight", F.explode(F.array_compact(holds)).alias("definition"))
    return own.groupBy("k", "definition", "share").agg(F.count(F.lit(1)).alias("needed"), F.count_if("by_ends").alias("by_ends"), F.count_if("by_hindsight").alias("by_hindsight"))


def line_kinds(rows: DataFrame) -> DataFrame:
    """k, kind, n: needed lines by kind, each once."""
    return rows.select("session_id", "call_pos", "k", "line_no", "kind").distinct().groupBy("k", "kind").agg(F.count(F.lit(1)).alias("n"))


def cases(rows: DataFrame, share: float, show: int) -> DataFrame:
    """Lines that one of both cuts keeps, spaced evenly: `show` for each kind and outcome at most."""
    tag = F.when(F.col("by_hindsight") & ~F.col("by_ends"), "won").when(~F.col("by_hindsight") & F.col("by_ends"), "lost")
    own = rows.where(F.col("share") == share).withColumn("tag", tag).where("tag is not null")
    w = Window.partitionBy("k", "kind", "tag")
    own = own.withColumns({"place": F.row_number().over(w.orderBy("session_id", "call_pos", "line_no")) - 1, "of": F.count(F.lit(1)).over(w)})
    step = F.greatest(F.lit(1), F.floor(F.col("of") / show))
    return own.where((F.col("place") % step == 0) & (F.col("place") / step < show)).select("k", "kind", "tag", "session_id", "call_pos", "line_no", "line")


def referenced(result: Column, later: Column) -> Column:
    """The distinct lines of 41 to 199 characters, stripped, that a later text has, in their order."""
    lines = F.filter(F.transform(split_lines(result), strip), lambda x: (F.length(x) > 40) & (F.length(x) < 200))
    return F.array_distinct(F.filter(lines, lambda x: F.contains(later, x)))


def trim_report(outputs: DataFrame, scores: Column, keep: float) -> DataFrame:
    """outputs(..., result, used): the output without its chunks below the threshold against both of its ends in equal size:
    n_chars, n_trimmed, n_used, kept_by_score, kept_by_ends (used lines by text), n_kept, n_chunks."""
    rows = outputs.withColumn("pieces", chunks(F.col("result"))).withColumn("scores", scores)
    rows = rows.withColumn("trimmed", selection.trim_chunks(F.col("pieces"), F.col("scores"), keep))
    rows = rows.withColumn("ends", head_tail(F.col("result"), F.length("trimmed")))
    survive = lambda c: F.size(F.filter("used", lambda x: F.contains(F.col(c), x)))
    return rows.select(
        *(c for c in outputs.columns if c not in ("result", "used")),
        F.length("result").alias("n_chars"),
        F.length("trimmed").alias("n_trimmed"),
        F.size("used").alias("n_used"),
        survive("trimmed").alias("kept_by_score"),
        survive("ends").alias("kept_by_ends"),
        F.size(F.filter("scores", lambda s: F.coalesce(s, F.lit(0.0)) >= keep)).alias("n_kept"),
        F.size("pieces").alias("n_chunks"),
    )


def line_scores(lines: Column, chars: Column) -> Column:
    """The mean of the character scores of each line (null for a line without any); a line end counts one character. The text is
    gone through once: places are sums of the lengths before."""
    sizes = F.transform(lines, lambda x: F.length(x))
    none = F.array().cast("array<struct<n: int, at: int>>")
    step = lambda a, n: F.struct((a["at"] + n + 1).alias("at"), F.array_append(a["out"], F.struct(n.alias("n"), a["at"].alias("at"))).alias("out"))
    places = F.aggregate(sizes, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda a: a["out"])
    mean = lambda own: F.when(F.size(own) > 0, F.aggregate(own, F.lit(0.0), lambda a, y: a + y) / F.size(own))
    return bound(chars, lambda c: F.transform(places, lambda p: bound(F.slice(c, p["at"] + 1, p["n"]), mean)))


def first_jobs(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in an order that leaves no ties."""
    return rows.orderBy(*order).limit(n)
