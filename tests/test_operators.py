import json
import random

from pyspark.sql import functions as F

from logloom.functions import text
from logloom.operators import labels, policy, selection, sessions
from logloom.sources import sessions as source
from logloom.streaming import stateless

KEY = "test-key"


def apply(spark, column, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string").select("i", column(F.col("t")).alias("out"))
    return [r.out for r in sorted(rows.collect())]


def test_lines_and_space(spark):
    cases = ["", "a", "a\n", "a\r\nb\rc\x0bd e\x85", "\n\n"]
    assert apply(spark, text.split_lines, cases) == [c.splitlines() for c in cases]
    cases = ["", "  a \t b\xa0c\x1cd  ", " x "]
    assert apply(spark, text.collapse_space, cases) == [" ".join(c.split()) for c in cases]


def test_previews_and_chunks(spark):
    assert apply(spark, text.preview, ["x" * 840, "x" * 5000]) == ["x" * 840, "x" * 600 + "\n[... 4200 chars ...]\n" + "x" * 200]
    cut = lambda b: apply(spark, lambda t: text.head_tail(t, F.lit(b)), ["abcdefghij" * 20])[0]
    assert len(cut(100)) == 107 and cut(0) == "\n[...]\n" + "abcdefghij" * 20 and cut(200) == "abcdefghij" * 20
    long = "\n".join(f"line {i}" for i in range(2000))
    pieces = apply(spark, text.chunks, [long])[0]
    assert len(pieces) <= 24 and "\n".join(pieces) == long


def test_decide(spark):
    row = lambda s, c, tool, drop, protect: spark.range(1).select(policy.decide(F.lit(s), F.lit(c), F.lit(tool), drop_calls=drop, protect=protect)).first()[0]
    assert row(0.1, 0.1, "Bash", True, True) == "truncate" and row(0.1, 0.1, "Bash", True, False) == "drop"
    assert row(0.1, 0.1, "Read", True, True) == "drop" and row(0.1, 0.1, "Read", False, True) == "truncate"
    assert row(0.9, 0.1, "Bash", True, True) == "keep"


def pruned(lines, scores, threshold):
    """Brute force for line_prune."""
    keep = [n for n, s in enumerate(scores) if s is not None and s >= threshold]
    keep = set(keep) | {b - 1 for a, b in zip(keep, keep[1:]) if b - a == 2}
    out, gap = [], []
    for n, line in enumerate(lines):
        if n not in keep or not line.strip():
            gap.append(line)
            continue
        if gap:
            out += [f"(filtered {len(gap)} lines)"] if sum(map(len, gap)) > 18 else gap
        gap = []
        out.append(line)
    return "\n".join(out + ([f"(filtered {len(gap)} lines)"] if gap else []))


def filled(ranked, budget):
    used, kept = 0, []
    for i, size in ranked:
        if used + size + 1 <= budget:
            used += size + 1
            kept.append(i)
    return kept


def test_pruning_and_filling_equal_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        lines = [rng.choice(["", "a", "\t", " \u2003", "some words of a line", "longer " * 5]) for _ in range(rng.randint(0, 12))]
        rows.append((i, lines, [rng.choice([0.0, 0.4, 0.6, None]) for _ in lines]))
    df = spark.createDataFrame(rows, "i int, lines array<string>, scores array<double>")
    got = {r.i: r.p for r in df.select("i", selection.prune_lines(F.col("lines"), F.col("scores"), 0.5).alias("p")).collect()}
    assert got == {i: pruned(lines, scores, 0.5) for i, lines, scores in rows}
    ranked = F.transform("lines", lambda x, i: F.struct(i.alias("i"), F.length(x).alias("size")))
    got = {r.i: r.k for r in df.select("i", text.fill_budget(ranked, F.lit(60.0)).alias("k")).collect()}
    assert got == {i: filled([(k, len(x)) for k, x in enumerate(lines)], 60) for i, lines, _ in rows}


def say(kind, *blocks):
    return json.dumps({"type": kind, "timestamp": "t", "message": {"content": list(blocks)}})


def test_sessions(spark, tmp_path):
    use = lambda i, name, **k: {"type": "tool_use", "id": i, "name": name, "input": k}
    answer = lambda i, x, **k: {"type": "tool_result", "tool_use_id": i, "content": x, **k}
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "s1.jsonl").write_text("\n".join([
        json.dumps({"type": "user", "message": {"content": "not seen"}}),
        "{bad",
        say("user", {"type": "text", "text": "<command-name>x"}, {"type": "text", "text": "fix   the\nbug"}),
        say("assistant", {"type": "text", "text": "I read"}, use("a", "Read", file_path=" /p/main.py ")),
        say("user", answer("a", [{"type": "text", "text": "one"}, {"type": "text", "text": "two"}])),
        say("user", answer("zz", "nobody asked"), answer("b", "too early")),
        say("assistant", use("b", "Edit", file_path="/p/main.py"), use("c", "Bash", n=1), {"type": "tool_use"}),
        say("user", answer("b", "first"), answer("b", "done", is_error=True), answer("c", "")),
        say("assistant", {"type": "text", "text": "over"}),
    ]))
    files = source.session_files(spark, str(tmp_path), least_bytes=10)
    blocks = sessions.blocks(source.session_lines(files)).cache()
    assert [r.goal for r in sessions.goals(blocks).collect()] == ["fix the bug"]
    texts, calls = sessions.texts(blocks), sessions.calls(blocks)
    assert [(r.text_index, r.body) for r in texts.orderBy("text_index").collect()] == [(0, "I read"), (1, "over")]
    rows = [(r.call_pos, r.call_index, r.tool, r.target, r.result, r.is_error, r.text_index, r.narration) for r in calls.orderBy("call_pos").collect()]
    assert rows == [(0, 0, "Read", "/p/main.py", "one\ntwo", False, 1, "I read"), (1, 1, "Edit", "/p/main.py", "done", True, 1, "I read")]
    kinds = [(r.kind, r.body) for r in sessions.events(calls, texts).orderBy("pos").collect()]
    assert [k for k, _ in kinds] == ["agent", "agent", "tool", "agent", "tool", "agent"] and kinds[0][1] == "I read" and kinds[-1][1] == "over"
    out = {r.call_pos: (r.label, r.kind) for r in labels.weak_labels(calls, texts, preserve=0).collect()}
    assert out[0] == (1, "gold") and out[1][1] == "proxy"
    assert labels.weak_labels(calls, texts).count() == 0
    state = calls.join(sessions.goals(blocks), "session_id").select(sessions.state_of(KEY).alias("s")).first().s
    assert state.tool in ("Read", "Edit") and state.goal == "fix the bug"
    assert source.session_files(spark, str(tmp_path)).count() == 0


def test_lenient_decoding_and_strict_pairs(spark, tmp_path):
    (tmp_path / "s2.jsonl").write_bytes(b'{"type": "user", "message": {"content": [{"type": "text", "text": "a\xffb"}]}}\n\xfe{}\n')
    lines = source.session_lines(source.session_files(spark, str(tmp_path), least_bytes=1))
    assert [r.goal for r in sessions.goals(sessions.blocks(lines)).collect()] == ["a\ufffdb"]
    assert source.session_files(spark, str(tmp_path), 1, without=tmp_path.name).count() == 0
    pairs = tmp_path / "pairs.txt"
    pairs.write_text('{"a": "x"}\n\t\n \u2003\n{"a": null}\n')
    assert source.pair_rows(spark, str(pairs)).count() == 2
    source.write_pairs(spark.createDataFrame([("x", None)], "a string, b string"), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"a":"x","b":null}']
    (tmp_path / "names").write_text("Quill  tools\nab Odo\u2003quill\n")
    assert sorted(r.name for r in source.name_list(spark, str(tmp_path / "names")).collect()) == ["odo", "quill"]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "mail jo@mail.example"), (2, "the invoice")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    rows = stateless.cleaned(stateless.text_stream(spark, str(tmp_path / "in")), KEY)
    stateless.run(rows, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, "mail [REDACTED]")]
