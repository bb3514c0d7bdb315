"""Queries over session records. The tables hold none, so documents are recorded as sessions first: a source is a session,
and each of its documents, in the order of doc_id, a call of an agent that answers with the document's text. The records
are written as files to the shared folder and read back as any session would be.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import chunks
from ..operators import context, harvest, labels, metrics, policy, retention, selection, sessions
from ..sources import sessions as source
from ..sources.storage import fresh, stored

TOOLS = ["Bash", "Read", "Edit", "mcp__mail__send", "Write", "Read"]
#: For these fixtures only: pseudonyms of real data need a key of their own.
FIXTURE_KEY = "fixture-key"
KS, SHARES = (5, 10, 20), selection.SMALL_SIZES
LEAST_BYTES = 1000


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))


def records(docs: DataFrame) -> DataFrame:
    """session_id, line_no, line: two records for each document, what the agent says and calls, and what it is told."""
    n = F.col("doc_id")
    said = F.struct(F.lit("text").alias("type"), F.left("text", F.lit(300)).alias("text"))
    given = F.struct(F.when(n % 2 == 0, F.concat(F.lit("step "), n % 7)).alias("description"), F.concat(F.lit("/work/"), "lang", F.lit("/part"), n % 17, F.lit(".txt")).alias("file_path"))
    use = F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("c"), n).alias("id"), F.get(F.array(*map(F.lit, TOOLS)), (n % 6).cast("int")).alias("name"), given.alias("input"))
    note = F.struct(F.lit("text").alias("type"), F.concat(F.lit("note "), F.left("text", F.lit(100))).alias("text"))
    answer = F.struct(F.lit("tool_result").alias("type"), F.concat(F.lit("c"), n).alias("tool_use_id"), F.col("text").alias("content"), (n % 11 == 0).alias("is_error"))

    def record(kind: str, *blocks: Column) -> Column:
        # blocks differ in their fields, so each is written on its own
        content = F.concat_ws(",", *blocks)
        return F.concat(F.lit(f'{{"type":"{kind}","timestamp":"t'), n, F.lit('","message":{"content":['), content, F.lit("]}}"))

    agent = record("assistant", F.when(n % 3 != 0, F.to_json(said)), F.to_json(use))
    told = record("user", F.to_json(note), F.to_json(answer))
    return docs.select(F.col("source").alias("session_id"), F.inline(F.array(F.struct((2 * n).alias("line_no"), agent.alias("line")), F.struct((2 * n + 1).alias("line_no"), told.alias("line")))))


def folder(spark: SparkSession, sf: str) -> str:
    path = fresh(spark, "sessions")
    source.write_sessions(records(_documents(spark, sf)), path)
    return path


def files(spark: SparkSession, sf: str) -> DataFrame:
    return source.session_files(spark, folder(spark, sf), least_bytes=LEAST_BYTES)


def rebuilt(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """calls, texts and goals of the recorded sessions, each written once."""
    rows = stored(sessions.blocks(source.session_records(spark, folder(spark, sf), LEAST_BYTES)).drop("block"), "blocks")
    return stored(sessions.calls(rows), "calls"), stored(sessions.texts(rows), "texts"), sessions.goals(rows)


def session_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions with how many of their lines are records."""
    return source.last_records(spark, folder(spark, sf), LEAST_BYTES)


def session_calls(spark: SparkSession, sf: str) -> DataFrame:
    calls = rebuilt(spark, sf)[0]
    return calls.select("session_id", "call_pos", "call_index", "id", "tool", "target", "input_json", F.length("result").alias("n_chars"), "is_error", "text_index", "ts", "narration", sessions.tool_name(F.col("tool")).alias("shown_tool"))


def session_texts(spark: SparkSession, sf: str) -> DataFrame:
    return rebuilt(spark, sf)[1]


def session_goals(spark: SparkSession, sf: str) -> DataFrame:
    return rebuilt(spark, sf)[2]


def session_events(spark: SparkSession, sf: str) -> DataFrame:
    calls, texts, _ = rebuilt(spark, sf)
    return sessions.events(calls, texts).select("session_id", "pos", "kind", F.md5("body").alias("digest"), "call_pos")


def raw_fields(spark: SparkSession, sf: str) -> DataFrame:
    calls, _, goals = rebuilt(spark, sf)
    return calls.join(goals, "session_id").select("session_id", "call_pos", sessions.raw_fields().alias("raw")).select("session_id", "call_pos", "raw.*")


def call_queries(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.call_query(rebuilt(spark, sf)[0])


def next_messages(spark: SparkSession, sf: str) -> DataFrame:
    calls, texts, _ = rebuilt(spark, sf)
    return sessions.next_message(calls, texts)


def decision_calls(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.decision_points(rebuilt(spark, sf)[0], 5, "text_index").select("session_id", "call_pos", "now_pos", "now_text_index")


def weak_label_rows(spark: SparkSession, sf: str) -> DataFrame:
    calls, texts, _ = rebuilt(spark, sf)
    return labels.weak_labels(calls, texts)


def weak_label_counts(spark: SparkSession, sf: str) -> DataFrame:
    return weak_label_rows(spark, sf).groupBy("kind", "label", "why").agg(F.count(F.lit(1)).alias("n"))


def labels_at(spark: SparkSession, sf: str) -> DataFrame:
    """Calls whose target is looked for behind the tenth call after them."""
    calls, texts, _ = rebuilt(spark, sf)
    return context.label_at(sessions.decision_points(calls, 10), calls, texts)


def context_areas(spark: SparkSession, sf: str) -> DataFrame:
    """Two plain scores against the label at the tenth call after."""
    calls, texts, _ = rebuilt(spark, sf)
    sizes = calls.select("session_id", "call_pos", F.length("input_json").alias("n_input"), F.length("result").alias("n_result"))
    rows = context.label_at(sessions.decision_points(calls, 10), calls, texts).hint("merge").join(sizes, ["session_id", "call_pos"])
    out = context.area_report(stored(rows, "scores"), "label", {"short input": -F.col("n_input"), "short result": -F.col("n_result")})
    return out.select("score", "positives", "negatives", F.round("auc", 9).alias("auc"), F.round("spread", 6).alias("spread"))


def context_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The states of a stratified sample of calls at random decision points. Labels are found without results; only the calls of
    the sample, and those before their points, are gone back to."""
    calls, texts, goals = rebuilt(spark, sf)
    points = context.random_points(calls.select("session_id", "call_pos", "target"))
    some = stored(context.stratified(context.label_at(points, calls, texts), "label", 150, "session_id", "call_pos"), "sample")
    points = calls.join(F.broadcast(some), ["session_id", "call_pos"])
    return context.context_states(points, calls, goals, FIXTURE_KEY, few=True).join(some, ["session_id", "call_pos", "now_pos"]).select("session_id", "call_pos", "now_pos", "label", "state.*")


def harvest_rows(spark: SparkSession, sf: str) -> DataFrame:
    calls, texts, goals = rebuilt(spark, sf)
    return harvest.judged(calls, texts, goals, FIXTURE_KEY).select("session_id", "call_pos", "label", "kind", "why", "reason")


def harvest_counts(spark: SparkSession, sf: str) -> DataFrame:
    calls, texts, goals = rebuilt(spark, sf)
    return harvest.counts(harvest.judged(calls, texts, goals, FIXTURE_KEY))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    calls, texts, goals = rebuilt(spark, sf)
    return stored(harvest.pairs(harvest.judged(calls, texts, goals, FIXTURE_KEY), FIXTURE_KEY), "pairs")


def harvest_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("state.*", "questions.keep_result.instructions", "answers.keep_result.noul", "label", "label_reason", "session")


def pair_audit(spark: SparkSession, sf: str) -> DataFrame:
    """What the audit finds in the harvested pairs, by detector, with the reasons of rows that should have gone."""
    found, gone, _ = harvest.audit(_pairs(spark, sf))
    return found.select(F.col("detector").alias("what"), "n").unionByName(gone.select(F.concat(F.lit("gone: "), "reason").alias("what"), "n"))


def pair_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return harvest.audit(_pairs(spark, sf))[2]


def retention_matrix(spark: SparkSession, sf: str) -> DataFrame:
    calls, texts, _ = rebuilt(spark, sf)
    return retention.matrix(retention.cuts(calls, texts, KS, SHARES))


def needed_line_kinds(spark: SparkSession, sf: str) -> DataFrame:
    calls, texts, _ = rebuilt(spark, sf)
    return retention.line_kinds(retention.needed_lines(calls, texts, KS).where("kind is not null"))


def retention_cases(spark: SparkSession, sf: str) -> DataFrame:
    calls, texts, _ = rebuilt(spark, sf)
    return retention.cases(retention.cuts(calls, texts, KS[:1], SHARES), SHARES[1], 5)


def trim_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Bash outputs of 4,000 characters or more, trimmed by chunk number (every third goes), against both ends in equal size;
    used lines are those that the agent's own text repeats."""
    calls = rebuilt(spark, sf)[0].where((F.col("tool") == "Bash") & (F.length("result") >= retention.LONG))
    outputs = calls.select("session_id", "call_pos", "result", retention.referenced(F.col("result"), F.concat_ws("\n", "narration", F.right("result", F.lit(400)))).alias("used"))
    return retention.trim_report(outputs, F.transform(chunks(F.col("result")), lambda x, i: (i % 3) / 2.0), 0.5)


def brand_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The ten commonest labels of the pages' hosts (without their reserved middle) that are not known."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select(F.replace("url", F.lit(".example."), F.lit(".")).alias("content"))
    return harvest.brands(pages, spark.createDataFrame([("tionsh",), ("example",)], "name string"), 10)


def raw_pair_audit(spark: SparkSession, sf: str) -> DataFrame:
    """What the audit finds in rows that nobody redacted, and the rows that should have gone."""
    text = F.col("text")
    state = F.struct(F.left(text, F.lit(400)).alias("goal"), F.lit("").alias("said"), F.to_json(F.struct(F.col("lang").alias("file_path"))).alias("input"), text.alias("result"))
    found, gone, _ = harvest.audit(_documents(spark, sf).select(state.alias("state"), F.col("source").alias("session")))
    return found.select(F.col("detector").alias("what"), "n").unionByName(gone.select(F.concat(F.lit("gone: "), "reason").alias("what"), "n"))


def json_walk(spark: SparkSession, sf: str) -> DataFrame:
    """Paths and strings of nested documents."""
    state = F.struct(F.struct(F.left("text", F.lit(30)).alias("goal"), F.array("lang", "source").alias("kinds")).alias("state"), F.array(F.struct(F.col("lang").alias("a"), F.array(F.array("source")).alias("b"))).alias("more"), F.col("doc_id").alias("n"))
    rows = _documents(spark, sf).select("doc_id", F.to_json(state).alias("json"))
    return sessions.strings_of(rows, "doc_id", "json")


def line_score_means(spark: SparkSession, sf: str) -> DataFrame:
    """The means of character scores (a character's place mod 5) over each line."""
    docs = _documents(spark, sf).where("length(text) <= 3000 and length(text) > 0").withColumn("lines", F.split("text", "\n"))
    scores = F.transform(F.sequence(F.lit(0), F.length("text") - 1), lambda i: (i % 5).cast("double"))
    rows = docs.select("doc_id", F.posexplode(retention.line_scores(F.col("lines"), scores)).alias("line_no", "mean"))
    return rows.select("doc_id", "line_no", F.round("mean", 6).alias("mean"))


def size_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of both cuts at each size, sizes as columns."""
    rows = retention_matrix(spark, sf).where("k = 5 and definition = 'all uses'")
    rows = rows.select("share", F.inline(F.array(F.struct(F.lit("ends").alias("method"), F.col("by_ends").alias("kept"), "needed"), F.struct(F.lit("hindsight").alias("method"), F.col("by_hindsight").alias("kept"), "needed"))))
    wide = rows.groupBy("method").pivot("share", list(SHARES)).agg(F.round(metrics.ratio(F.col("kept"), F.col("needed")), 6))
    return wide.select("method", *(F.col(f"`{s}`").alias(f"at_{round(100 * s)}") for s in SHARES))


def preserved_calls(spark: SparkSession, sf: str) -> DataFrame:
    """The calls that the age baseline would drop."""
    calls = rebuilt(spark, sf)[0]
    return calls.withColumn("old", policy.too_old(["call_pos"], "session_id")).where("old").select("session_id", "call_pos")


RECORDED: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        session_scan, session_calls, session_texts, session_goals, session_events, raw_fields, call_queries, next_messages, decision_calls, weak_label_rows,
        weak_label_counts, labels_at, context_areas, context_rows, harvest_rows, harvest_counts, harvest_pairs, pair_audit, raw_pair_audit, pair_verdict, retention_matrix,
        needed_line_kinds, retention_cases, trim_recall, brand_counts, json_walk, line_score_means, size_matrix, preserved_calls,
    )
}
