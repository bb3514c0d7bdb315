"""Sessions rebuilt from their records: texts, calls with results, goals, and the timeline of events.

All windows are over a session's own rows in file order. Of calls that share an id the last one stands; an answer counts
for the call if it comes after it, and the last one stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, NullType, NumericType, StringType, StructType

from ..functions import patterns as P
from ..functions.text import collapse_space, head_tail, preview, strip
from ..functions.redaction import redact
from ..sources.storage import stored

# Fixed values.
NO_GOAL = "(no task text found)"
TARGET_KEYS = ("file_path", "path", "pattern", "command", "url", "query", "notebook_path")


def blocks(lines: DataFrame) -> DataFrame:
    """lines(session_id, line_no, record): a row for each object in a record's list of contents, with its place. What several
    fields are read from stands behind an explode, so that it is computed once."""
    content = F.expr("try_variant_get(record, '$.message.content', 'array<variant>')")
    rows = lines.select("session_id", "line_no", F.expr("try_variant_get(record, '$.type', 'string')").alias("speaker"), F.expr("try_variant_get(record, '$.timestamp', 'string')").alias("ts"), F.posexplode(content).alias("block_pos", "block"))
    rows = rows.where(F.schema_of_variant("block").startswith("OBJECT"))
    field = lambda k, kind="string": F.expr(f"try_variant_get(block, '$.{k}', '{kind}')")
    return rows.select("session_id", "line_no", "block_pos", F.col("speaker").alias("speaker"), "ts", field("type").alias("kind"), "block", field("id").alias("id"), field("name").alias("name"), field("input", "variant").alias("input"), field("tool_use_id").alias("tool_use_id"), field("is_error", "boolean").alias("is_error"), F.explode(F.array(F.expr("coalesce(try_variant_get(block, '$.content', 'variant'), try_variant_get(block, '$.text', 'variant'))"))).alias("raw")).withColumn("body", text_of("raw")).drop("raw")


def text_of(raw: str) -> Column:
    """The text of a block's content or text (a variant column): strings as they are, lists as their items' texts, others as JSON."""
    kind = f"schema_of_variant({raw})"
    return F.expr(
        f"case when {raw} is null then '' when {kind} = 'STRING' then variant_get({raw}, '$', 'string')"
        f" when {kind} like 'ARRAY%' then array_join(transform(filter(variant_get({raw}, '$', 'array<variant>'), x -> schema_of_variant(x) like 'OBJECT%'), x -> coalesce(try_variant_get(x, '$.text', 'string'), '')), '\\n')"
        f" else left(to_json({raw}), 4000) end"
    )


def _order(*partition: str):
    return Window.partitionBy("session_id", *partition).orderBy("line_no", "block_pos")


def texts(rows: DataFrame) -> DataFrame:
    """session_id, text_index (from 0), body of the assistant's texts."""
    own = rows.where("speaker = 'assistant' and kind = 'text'")
    return own.select("session_id", (F.row_number().over(_order()) - 1).alias("text_index"), "body")


def goals(rows: DataFrame) -> DataFrame:
    """session_id, goal: the first text of others that is neither blank nor the host's, in one line of 2000 characters."""
    mine = (F.col("speaker").isNull() | (F.col("speaker") != "assistant")) & (F.col("kind") == "text") & (strip(F.col("body")) != "") & ~F.col("body").rlike(P.regex(P.HOST_TEXT))
    first = F.min_by(F.when(mine, F.left(collapse_space(F.col("body")), F.lit(2000))), F.when(mine, F.struct("line_no", "block_pos")))
    return rows.groupBy("session_id").agg(F.coalesce(first, F.lit(NO_GOAL)).alias("goal"))


def target_of(payload: str) -> Column:
    """The first of the known keys that holds a string, stripped; else the start of the input's JSON."""
    string = lambda k: f"if(schema_of_variant(try_variant_get({payload}, '$.{k}', 'variant')) = 'STRING', try_variant_get({payload}, '$.{k}', 'string'), null)"
    return F.coalesce(*(strip(F.expr(string(k))) for k in TARGET_KEYS), F.left(F.expr(f"to_json({payload})"), F.lit(200)))


def narration(is_text: Column, body: Column, over) -> Column:
    """The last text of the assistant in the frame; the empty text before the first."""
    return F.coalesce(F.last(F.when(is_text, body), ignorenulls=True).over(over), F.lit(""))


def texts_before(is_text: Column, over) -> Column:
    """How many texts of the assistant are in the frame."""
    return F.coalesce(F.count_if(is_text).over(over), F.lit(0))


def next_text(is_text: Column, body: Column, order) -> Column:
    """The next text of the assistant behind a row; null where none follows."""
    return F.first(F.when(is_text, body), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))


def calls(rows: DataFrame) -> DataFrame:
    """The calls that have a result: session_id, call_pos (dense), call_index (over all calls), id, tool, input_json, target,
    result, is_error, text_index, ts, narration. Places are found without texts and results, which are met once by them."""
    spot = ["session_id", "line_no", "block_pos"]
    assistant = F.col("speaker") == "assistant"
    marks = rows.select(*spot, (assistant & (F.col("kind") == "text")).alias("is_text"), (assistant & (F.col("kind") == "tool_use")).alias("is_use"), "id").where("is_text or is_use")
    running = _order().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    used = marks.withColumns({"text_index": texts_before(F.col("is_text"), running).cast("int"), "call_index": (F.count_if("is_use").over(running) - 1).cast("int")}).where("is_use")
    used = used.withColumn("id", F.coalesce("id", F.concat(F.lit("t"), F.col("call_index"))))
    # a call's answer is the last one of its id behind it, and of calls with one id the last one stands
    asked = used.select(*spot, "id", "call_index", "text_index", F.lit(False).alias("empty"))
    answers = rows.where("kind = 'tool_result' and tool_use_id is not null").select(*spot, F.col("tool_use_id").alias("id"), F.lit(None).cast("int").alias("call_index"), F.lit(None).cast("int").alias("text_index"), (F.col("body") == "").alias("empty"))
    both = asked.unionByName(answers)
    place = F.struct("line_no", "block_pos")
    by_id = both.groupBy("session_id", "id").agg(
        F.max_by(F.struct(place.alias("place"), "call_index", "text_index"), F.when(F.col("call_index").isNotNull(), place)).alias("use"),
        F.max_by(F.struct(place.alias("place"), "empty"), F.when(F.col("call_index").isNull(), place)).alias("answer"),
    )
    met = by_id.where("use is not null and answer.place > use.place and not answer.empty")
    pos = F.row_number().over(Window.partitionBy("session_id").orderBy("use.call_index")) - 1
    met = met.select("session_id", pos.alias("call_pos"), "use.call_index", "id", "use.text_index", F.col("use.place").alias("of"), F.col("answer.place").alias("at"))
    # inputs and narrations are short beside results, so they meet first
    given = rows.where("speaker = 'assistant' and kind = 'tool_use'").select("session_id", place.alias("of"), F.coalesce("name", F.lit("?")).alias("tool"), "input", "ts")
    said = texts(rows).select("session_id", (F.col("text_index") + 1).alias("text_index"), F.col("body").alias("narration"))
    met = met.hint("merge").join(given, ["session_id", "of"]).hint("merge").join(said, ["session_id", "text_index"], "left")
    payload = F.when(F.col("input").isNull() | F.expr("is_variant_null(input)"), F.parse_json(F.lit("{}"))).otherwise(F.col("input"))
    met = met.withColumn("input", payload)
    met = met.select("session_id", "at", "call_pos", "call_index", "id", "tool", F.expr("to_json(input)").alias("input_json"), target_of("input").alias("target"), "text_index", "ts", F.coalesce("narration", F.lit("")).alias("narration"))
    told = rows.where("kind = 'tool_result'").select("session_id", place.alias("at"), F.col("body").alias("result"), F.coalesce("is_error", F.lit(False)).alias("is_error"))
    out = told.hint("merge").join(met, ["session_id", "at"])
    return out.select("session_id", "call_pos", "call_index", "id", "tool", "input_json", "target", "result", "is_error", "text_index", "ts", "narration")


def events(calls: DataFrame, texts: DataFrame) -> DataFrame:
    """session_id, pos, kind (agent or tool), body, call_pos: for each call the texts before it, its input, its result; the
    texts that are left stand last. Calls and texts are numbered densely, so each call knows its place (`call_event`), and
    bodies stay where they are."""
    marks = calls.groupBy("session_id", "text_index").agg(F.count(F.lit(1)).cast("int").alias("calls"))
    marks = marks.select("session_id", (F.col("text_index") - 1).alias("at"), F.lit(1).alias("turn"), F.lit(None).cast("string").alias("body"), "calls")
    own = texts.select("session_id", F.col("text_index").alias("at"), F.lit(0).alias("turn"), "body", F.lit(0).alias("calls"))
    # a call with text_index n stands behind text n - 1
    before = F.sum("calls").over(Window.partitionBy("session_id").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = own.unionByName(marks).withColumn("before", before).where("turn = 0")
    rows = placed.select("session_id", (F.col("at") + 2 * F.col("before")).cast("int").alias("pos"), F.lit("agent").alias("kind"), "body", F.lit(None).cast("int").alias("call_pos"))
    for step, kind, body in ((0, "agent", "input_json"), (1, "tool", "result")):
        rows = rows.unionByName(calls.select("session_id", (call_event() + step).alias("pos"), F.lit(kind).alias("kind"), F.col(body).alias("body"), "call_pos"))
    return rows


def call_event() -> Column:
    """The place of a call's input among the events of its session; its result follows."""
    return (2 * F.col("call_pos") + F.col("text_index")).cast("int")


def tool_name(tool: Column) -> Column:
    return F.when(tool.isin(P.TOOLS), tool).otherwise("other")


def state_of(key: str, names: list[str] | None = None) -> Column:
    """The redacted struct of a call (goal, tool, input_json, result, is_error, narration). Redaction precedes every cut."""
    clean = lambda c: redact(F.col(c), key, names)
    return F.struct(
        F.left(clean("goal"), F.lit(400)).alias("goal"),
        tool_name(F.col("tool")).alias("tool"),
        F.left(preview(clean("input_json")), F.lit(400)).alias("input"),
        F.length("result").alias("result_chars"),
        F.col("is_error").alias("failed"),
        preview(clean("result")).alias("result"),
        F.left(redact(collapse_space(F.col("narration")), key, names), F.lit(200)).alias("said"),
    )


def raw_fields() -> Column:
    """What is tested before anything is redacted."""
    result = F.concat(F.left("result", F.lit(1000)), F.lit("\n"), F.right("result", F.lit(600)))
    return F.struct("goal", F.left("narration", F.lit(600)).alias("said"), F.left("input_json", F.lit(3000)).alias("input"), result.alias("result"))


def decision_points(calls: DataFrame, k: int, *more: str) -> DataFrame:
    """Each call with the k-th call after it (now_pos, and now_ for each column named), where at least one more follows."""
    w = Window.partitionBy("session_id").orderBy("call_pos")
    now = {f"now_{c}": F.lead(c, k).over(w) for c in more}
    return calls.withColumns({"now_pos": F.lead("call_pos", k).over(w), **now, "further": F.lead("call_pos", k + 1).over(w)}).where("further is not null").drop("further")


def call_query(calls: DataFrame) -> DataFrame:
    """session_id, call_pos, query: what is known of a call when it is made, its description or else its file, and the
    narration's first 300 characters, in one line."""
    field = lambda k: F.get_json_object("input_json", f"$.{k}")
    what = F.coalesce(field("description"), field("file_path"), F.lit(""))
    said = F.left(collapse_space(F.col("narration")), F.lit(300))
    return calls.select("session_id", "call_pos", collapse_space(F.concat(what, F.lit(". "), said)).alias("query"))


def next_message(calls: DataFrame, texts: DataFrame) -> DataFrame:
    """session_id, call_pos, message: the assistant's text right after the call (1000 characters in one line), or else the
    query of the call."""
    later = texts.select("session_id", "text_index", F.left(collapse_space(F.col("body")), F.lit(1000)).alias("message"))
    rows = calls.select("session_id", "call_pos", "text_index").join(later, ["session_id", "text_index"], "left").join(call_query(calls), ["session_id", "call_pos"])
    return rows.select("session_id", "call_pos", F.coalesce("message", "query").alias("message"))


def strings_of(rows: DataFrame, key: str, document: str) -> DataFrame:
    """key, path, value of every string in a JSON document, at any depth (a.b, c[0]; ? for a bare string), by levels: each
    level's containers are opened in an explode. What is no JSON gives no row."""
    spark = rows.sparkSession
    level = rows.select(F.col(key), F.lit("").alias("path"), F.try_parse_json(document).alias("v"))
    out = None
    while True:
        kind = F.schema_of_variant("v")
        level = stored(level.select(key, "path", kind.alias("kind"), F.when(kind == "STRING", F.try_variant_get("v", "$", "string")).alias("value"), F.to_json("v").alias("json")), "level")
        leaves = level.where("kind = 'STRING'").select(key, F.when(F.col("path") == "", "?").otherwise(F.col("path")).alias("path"), "value")
        out = leaves if out is None else out.unionByName(leaves)
        inner = level.where("kind like 'OBJECT%' or kind like 'ARRAY%'")
        if inner.isEmpty():
            return out
        inner = inner.select(key, "path", F.col("kind").startswith("OBJECT").alias("object"), F.parse_json("json").alias("v"))
        opened = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select(F.col("pos").alias("pos"), F.col("key").alias("name"), F.col("value").alias("inner")))
        step = F.when(~F.col("object"), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("path") == "", F.col("name")).otherwise(F.concat("path", F.lit("."), "name"))
        level = opened.select(key, step.alias("path"), F.col("inner").alias("v"))


def strings_in(value: Column, kind: DataType, path: Column | None = None) -> Column | None:
    """path and value of every string in a value of a known type, as `strings_of` gives them of its JSON; null (no Column) if the
    type holds others than strings, numbers, truth values, lists and structs of them."""
    empty = F.array().cast("array<struct<path: string, value: string>>")
    if isinstance(kind, StringType):
        return F.when(value.isNotNull(), F.array(F.struct((F.lit("?") if path is None else path).alias("path"), value.cast("string").alias("value")))).otherwise(empty)
    if isinstance(kind, NumericType | BooleanType | NullType):
        return empty
    if isinstance(kind, ArrayType):
        inner = lambda x, i: F.concat(F.lit("") if path is None else path, F.lit("["), i.cast("string"), F.lit("]"))
        if strings_in(value, kind.elementType, F.lit("")) is None:
            return None
        return F.coalesce(F.flatten(F.transform(value, lambda x, i: strings_in(x, kind.elementType, inner(x, i)))), empty)
    if isinstance(kind, StructType):
        parts = [strings_in(value[f.name], f.dataType, F.lit(f.name) if path is None else F.concat(path, F.lit("." + f.name))) for f in kind]
        return None if any(p is None for p in parts) else F.concat(empty, *parts)
    return None


def recent_steps(tool: Column, target: Column, over) -> Column:
    """The last five steps, oldest first."""
    return F.array_join(F.collect_list(F.concat(tool, F.lit(" "), F.left(target, F.lit(90)))).over(over.rowsBetween(-4, 0)), "\n")


def head_tail_of(body: str, share: float) -> Column:
    return head_tail(F.col(body), F.floor(F.length(body) * share).cast("int"))
