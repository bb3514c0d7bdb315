"""Decision points after a call: whether its target still comes up, the state of the work, and scores against that label."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.redaction import redact
from ..functions.text import base_name, collapse_space, preview
from . import labels, metrics, questions, sessions

FURTHEST = 40


def random_points(calls: DataFrame, furthest: int = FURTHEST) -> DataFrame:
    """Each call with a decision point (now_pos) 1 to `furthest` calls later, by a hash of session and call; calls whose
    point has no call behind it are left out."""
    n = calls.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    step = F.pmod(F.xxhash64("session_id", "call_pos"), F.lit(furthest)) + 1
    return calls.join(n, "session_id").withColumn("now_pos", (F.col("call_pos") + step).cast("int")).where("now_pos < n - 1").drop("n")


def label_at(points: DataFrame, calls: DataFrame, texts: DataFrame) -> DataFrame:
    """points(session_id, call_pos, target, now_pos): session_id, call_pos, now_pos, label: whether the name of the target (more
    than 3 characters; else no row) comes up after the decision point, in a text or in an input."""
    at = calls.select("session_id", F.col("call_pos").alias("now_pos"), F.col("text_index").alias("now_text_index"))
    rows = points.select("session_id", "call_pos", "now_pos", base_name(F.col("target")).alias("name")).where(F.length("name") > 3).join(at, ["session_id", "now_pos"])
    named = labels.last_mentions(rows.select("session_id", "name").distinct(), calls, texts)
    rows = rows.join(named, ["session_id", "name"], "left")
    hit = (F.col("last_text") >= F.col("now_text_index")) | (F.col("last_input") > F.col("now_pos"))
    return rows.select("session_id", "call_pos", "now_pos", F.coalesce(hit, F.lit(False)).cast("int").alias("label"))


def context_states(points: DataFrame, calls: DataFrame, goals: DataFrame, key: str, names: list[str] | None = None, few: bool = False) -> DataFrame:
    """session_id, call_pos, now_pos, state, question: the call and where the work is at the decision point. Only calls at a
    decision point, and the four before it, are redacted for it. few: the caller has bounded the points, so that they can be
    sent to all tasks."""
    clean = lambda c: redact(c, key, names)
    last = points.select("session_id", "now_pos").distinct().select("session_id", "now_pos", F.explode(F.sequence(F.greatest(F.col("now_pos") - 4, F.lit(0)), F.col("now_pos"))).alias("call_pos"))
    near = calls.select("session_id", "call_pos", "tool", "target", "narration").join(F.broadcast(last) if few else last.hint("merge"), ["session_id", "call_pos"])
    said = F.when(F.col("call_pos") == F.col("now_pos"), F.left(clean(collapse_space(F.col("narration"))), F.lit(250)))
    near = near.select("session_id", "now_pos", "call_pos", F.concat("tool", F.lit(" "), F.left(clean(F.col("target")), F.lit(90))).alias("step"), said.alias("said"))
    now = near.groupBy("session_id", "now_pos").agg(F.max("said").alias("agent_now"), F.array_sort(F.collect_list(F.struct("call_pos", "step"))).alias("steps"), F.max("call_pos").alias("last"))
    now = now.where("last = now_pos").select("session_id", "now_pos", "agent_now", F.expr("filter(transform(steps, x -> x.step), x -> x is not null)").alias("recent_steps"))
    rows = points.join(goals, "session_id").join(now, ["session_id", "now_pos"]).withColumn("base", sessions.state_of(key, names))
    state = F.struct(
        F.col("base.goal").alias("goal"),
        (F.col("now_pos") - F.col("call_pos")).alias("calls_since"),
        "agent_now",
        "recent_steps",
        F.col("base.tool").alias("tool"),
        F.left("base.input", F.lit(300)).alias("input"),
        F.col("base.result_chars").alias("result_chars"),
        F.left(preview(clean(F.col("result"))), F.lit(700)).alias("result"),
    )
    return rows.select("session_id", "call_pos", "now_pos", state.alias("state"), questions.keep_result_later(F.col("base.tool")).alias("question"))


def stratified(rows: DataFrame, label: str, n: int, *key: str) -> DataFrame:
    """n / 2 rows of each label at most, in the order of a hash of the key."""
    w = Window.partitionBy(label).orderBy(F.xxhash64(*key), *key)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n // 2).drop("place")


def area_report(rows: DataFrame, label: str, scores: dict[str, Column]) -> DataFrame:
    """score, positives, negatives, auc, spread (population standard deviation), for each named score."""
    out = None
    for name, score in scores.items():
        own = rows.select(score.alias("s"), F.col(label).alias("y"))
        one = metrics.auc(own, "s", "y").crossJoin(own.agg(F.stddev_pop("s").alias("spread"))).select(F.lit(name).alias("score"), "*")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no score is named")
    return out


def scored(rows: DataFrame, columns: list[str], scorer: Callable[[pd.DataFrame], pd.Series], name: str = "score") -> DataFrame:
    """rows with the scores that an outside model gives: `scorer` gets batches of the named columns and returns a number for
    each row. It is loaded where it runs, so it should hold its model in a module."""
    schema = rows.limit(0).withColumn(name, F.lit(0.0)).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{name: scorer(frame[columns]).astype(float)})

    return rows.mapInPandas(run, schema)
