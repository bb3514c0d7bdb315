"""Harvest, retention and decision points on small sessions against plain Python, and the commands."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from logloom import __main__ as command
from logloom.operators import context, harvest, labels, retention, sessions
from logloom.plans import recorded
from test_redaction import NAMES, slow_audit, slow_reason, slow_redact
import test_redaction

LINE_END = re.compile("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")


@pytest.fixture(scope="module")
def logs(spark):
    """Random sessions whose later texts and inputs repeat tokens and lines of earlier outputs."""
    rng = random.Random(11)
    token = lambda: f"tok_{rng.randrange(60):04d}/x"
    line = lambda: " ".join([token(), "plain", "words", token(), str(rng.randrange(10))])
    calls, texts = [], []
    for s in range(3):
        t = 0
        said = ""
        for p in range(24):
            while rng.random() < 0.5:
                said = f"I see {token()} and {token()}." + ("\n" + rng.choice(calls)[6].split("\n")[0] if calls and rng.random() < 0.3 else "")
                texts.append((f"s{s}", t, said))
                t += 1
            tool = rng.choice(["Bash", "Read", "Edit", "mcp__x"])
            result = "\n".join(line() for _ in range(rng.choice([2, 130])))
            if tool == "Read":
                result = "\n".join(f"  {i}\t{x}" for i, x in enumerate(result.split("\n")))
            target = f"/w/file{rng.randrange(6)}.txt"
            given = json.dumps({"file_path": target, "note": token()}, separators=(",", ":"))
            calls.append((f"s{s}", p, p, f"c{p}", tool, given, result, rng.random() < 0.1, t, "t", said, target))
    c = spark.createDataFrame(calls, "session_id string, call_pos int, call_index int, id string, tool string, input_json string, result string, is_error boolean, text_index int, ts string, narration string, target string")
    x = spark.createDataFrame(texts, "session_id string, text_index int, body string")
    return calls, texts, c.cache(), x.cache()


def timeline(calls, texts):
    events, at = [], []
    left = list(texts)
    for c in calls:
        while left and left[0][1] < c[8]:
            events.append((True, left.pop(0)[2]))
        at.append(len(events))
        events += [(True, c[5]), (False, c[6])]
    return events + [(True, t[2]) for t in left], at


def distinctive(line, known):
    return [t for t in re.findall(r"[\w./:@-]{8,}", line) if not t.isalpha() and t not in known]


def slow_cuts(calls, texts, ks, shares):
    """Rows of retention.cuts by plain loops."""
    out = {}
    for s in sorted({c[0] for c in calls}):
        own = [c for c in calls if c[0] == s]
        events, at = timeline(own, [t for t in texts if t[0] == s])
        for k in ks:
            for i, c in enumerate(own):
                if c[4] not in ("Bash", "Read") or len(c[6]) < 4000 or c[7] or i + k >= len(own) - 1:
                    continue
                body = re.sub(r"(?m)^\s*\d+\t", "", c[6]) if c[4] == "Read" else c[6]
                lines = body.split("\n")
                before, after = range(at[i] + 2, at[i + k] + 1), range(at[i + k] + 1, len(events))
                kinds, proven = {}, set()
                for n, line in enumerate(lines):
                    for token in distinctive(line, c[5] + c[10]):
                        mine = any(events[e][0] and token in events[e][1] for e in before)
                        if mine:
                            proven.add(n)
                        first = next((e for e in after if events[e][0] and token in events[e][1]), None)
                        if first is not None:
                            carried = any(not events[e][0] and token in events[e][1] for e in range(at[i] + 2, first))
                            kinds[n] = max(kinds.get(n, 0), 1 if mine else 2 if carried else 3)
                for share in shares:
                    budget, used, kept = share * len(body), 0, set()
                    for n in sorted(range(len(lines)), key=lambda n: (n not in proven, min(n, len(lines) - 1 - n), n)):
                        if used + len(lines[n]) + 1 <= budget:
                            kept.add(n)
                            used += len(lines[n]) + 1
                    whole = int(budget)
                    ends = body if len(body) <= whole else body[: int(whole * 0.7)] + "\n[...]\n" + body[-(whole - int(whole * 0.7)) :]
                    for n, kind in kinds.items():
                        out[s, i, k, share, n] = (["own", "recarried", "fresh"][kind - 1], lines[n] in ends, n in kept)
    return out


def test_cuts_equal_brute_force(logs):
    calls, texts, c, x = logs
    want = slow_cuts(calls, texts, (2, 5), (0.54, 0.15))
    rows = retention.cuts(c, x, (2, 5), (0.54, 0.15)).collect()
    assert {(r.session_id, r.call_pos, r.k, r.share, r.line_no): (r.kind, r.by_ends, r.by_hindsight) for r in rows} == want
    assert len({v[0] for v in want.values()}) >= 2 and len(rows) == len(want) > 100
    cases = retention.cases(retention.cuts(c, x, (2,), (0.54,)), 0.54, 2).collect()
    assert cases and all(r.tag in ("won", "lost") for r in cases)


def slow_labels(calls, texts, preserve):
    out = {}
    for s in sorted({c[0] for c in calls}):
        own = [c for c in calls if c[0] == s]
        said = [t[2] for t in texts if t[0] == s]
        for i, c in enumerate(own[: max(0, len(own) - preserve)]):
            rest, tail = own[i + 1 :], said[c[8] :]
            repeated = any(r[4] == c[4] and r[11] == c[11] for r in rest)
            edited = c[4] == "Read" and any(r[4] in ("Edit", "Write") and r[11] == c[11] for r in rest)
            lines = [x.strip() for x in LINE_END.split(c[6]) if 40 < len(x.strip()) < 200][:40]
            name = c[11].rpartition("/")[2]
            if edited and not repeated:
                out[s, i] = (1, "gold", labels.WHY[0])
            elif any(x in t for x in lines for t in tail):
                out[s, i] = (1, "gold", labels.WHY[1])
            elif repeated:
                out[s, i] = (0, "gold", labels.WHY[2])
            else:
                hit = any(name in t for t in tail) or any(name in r[5] for r in rest)
                out[s, i] = (int(hit), "proxy", labels.WHY[3 if hit else 4])
    return out


def test_labels_equal_brute_force(logs):
    calls, texts, c, x = logs
    for preserve in (0, 6):
        got = {(r.session_id, r.call_pos): (r.label, r.kind, r.why) for r in labels.weak_labels(c, x, preserve).collect()}
        assert got == slow_labels(calls, texts, preserve)
    assert len({v[2] for v in got.values()}) >= 3


def test_decision_points_and_states(spark, logs):
    calls, texts, c, x = logs
    got = {(r.session_id, r.call_pos): r.label for r in context.label_at(sessions.decision_points(c, 4), c, x).collect()}
    want = {}
    for s in ("s0", "s1", "s2"):
        own = [r for r in calls if r[0] == s]
        said = [t[2] for t in texts if t[0] == s]
        for i, r in enumerate(own):
            if i + 4 < len(own) - 1:
                name = r[11].rpartition("/")[2]
                want[s, i] = int(any(name in t for t in said[own[i + 4][8] :]) or any(name in o[5] for o in own[i + 5 :]))
    assert got == want and set(want.values()) == {0, 1}
    goals = spark.createDataFrame([(f"s{i}", "mend the parser") for i in range(3)], "session_id string, goal string")
    rows = context.context_states(sessions.decision_points(c, 4), c, goals, "k").collect()
    assert len(rows) == len(want) and all(r.state.calls_since == 4 and len(r.state.recent_steps) <= 5 for r in rows)
    points = context.random_points(c).collect()
    assert points and all(1 <= r.now_pos - r.call_pos <= 40 and r.now_pos < 23 for r in points)
    scored = context.scored(c.select("session_id", "call_pos", "result"), ["result"], lambda f: f["result"].str.len())
    assert {(r.session_id, r.call_pos): r.score for r in scored.collect()} == {(r[0], r[1]): len(r[6]) for r in calls}


def test_harvest_and_audit(spark, sf):
    key = recorded.FIXTURE_KEY
    test_redaction.KEY, own = key, test_redaction.KEY
    try:
        calls, texts, goals = recorded.rebuilt(spark, sf)
        goal = {r.session_id: r.goal for r in goals.collect()}
        call = {(r.session_id, r.call_pos): r for r in calls.collect()}
        weak = {(r.session_id, r.call_pos): r for r in labels.weak_labels(calls, texts).collect()}
        rows = harvest.judged(calls, texts, goals, key).collect()
        assert len(rows) == len(weak)
        short = lambda t: t if len(t) <= 840 else t[:600] + f"\n[... {len(t) - 800} chars ...]\n" + t[-200:]
        reason = lambda fields: next((w for w in (without_private(t) if k < 2 else slow_reason(t) for k, t in enumerate(fields)) if w), "")
        for r in rows:
            c, g = call[r.session_id, r.call_pos], goal[r.session_id]
            raw = (g, c.narration[:600], c.input_json[:3000], c.result[:1000] + "\n" + c.result[-600:])
            state = (slow_redact(g)[:400], slow_redact(" ".join(c.narration.split()))[:200], short(slow_redact(c.input_json))[:400], short(slow_redact(c.result)))
            want = harvest.UNKNOWN_TOOL if c.tool.startswith("mcp") else reason(raw) or reason(state)
            assert r.reason == want and (r.state.goal, r.state.said, r.state.input, r.state.result) == state
            assert (r.label, r.kind, r.why) == tuple(weak[r.session_id, r.call_pos][k] for k in ("label", "kind", "why"))
        pairs = recorded.harvest_pairs(spark, sf).collect()
        assert len(pairs) == sum(not r.reason for r in rows) > 0 and all(re.fullmatch("sess-[0-9a-f]{8}", p.session) for p in pairs)
        assert {(r.kind, r.label, r.reason): r.n for r in recorded.harvest_counts(spark, sf).collect()}[None, None, harvest.UNKNOWN_TOOL] == sum(r.reason == harvest.UNKNOWN_TOOL for r in rows)
    finally:
        test_redaction.KEY = own


def without_private(text):
    found = slow_reason(text)
    return None if found == "private context" else found


def test_audit_of_nested_rows(spark, sf):
    docs = recorded._documents(spark, sf).collect()
    strings = [(i, t) for i, d in enumerate(docs) for t in (d.text[:400], json.dumps({"file_path": d.lang}), d.text, d.source)]
    want = {k: n for k, (n, _) in slow_audit(strings).items()}
    got = {r.what: r.n for r in recorded.raw_pair_audit(spark, sf).collect()}
    assert {k: n for k, n in got.items() if not k.startswith("gone: ")} == want
    gone = [w for d in docs if (w := slow_reason(d.text[:400]) or slow_reason(d.text))]
    assert {k[6:]: n for k, n in got.items() if k.startswith("gone: ")} == {w: gone.count(w) for w in gone}
    assert recorded.pair_verdict(spark, sf).first().code in (0, 2)
    pairs = spark.createDataFrame([(("see Odo at wiki", "", "", ""), ["x", "quillfeather"])], "state struct<goal: string, said: string, input: string, result: string>, more array<string>")
    found, _, verdict = harvest.audit(pairs, names=NAMES)
    assert {r.detector: [s for s in r.samples] for r in found.collect()} == {"name: odo": ["odo"], "name: quillfeather": ["quillfeather"]} and verdict.first().code == 2


def test_strings_at_any_depth(spark):
    rows = [(1, '{"a":{"b":"x","c":["y",{"d":"z"},3,null]},"e":"w"}'), (2, '"bare"'), (3, '[["q"],"r"]'), (4, "bad{"), (5, None), (6, "{}")]
    got = {(r.id, r.path, r.value) for r in sessions.strings_of(spark.createDataFrame(rows, "id int, j string"), "id", "j").collect()}
    assert got == {(1, "a.b", "x"), (1, "a.c[0]", "y"), (1, "a.c[1].d", "z"), (1, "e", "w"), (2, "?", "bare"), (3, "[0][0]", "q"), (3, "[1]", "r")}


def test_commands(spark, sf, tmp_path, capsys):
    files = recorded.files(spark, sf)
    root = files.first().path.rpartition("/")[0]
    common = [root, "--least-bytes", "1000"]
    assert command.main(["harvest", *common, "--key", "k", "--out", str(tmp_path / "pairs")]) == 0
    assert "gold" in capsys.readouterr().out
    assert command.main(["audit", str(tmp_path / "pairs")]) in (0, 2)
    assert command.main(["hosts", *common, "--most", "5"]) == 0
    assert command.main(["trim", *common, "--limit", "3"]) == 0
    calls = recorded.rebuilt(spark, sf)[0]
    calls.select("session_id", "call_pos", F.lit(0.6).alias("score"), F.lit(0.1).alias("call_score")).write.parquet(str(tmp_path / "scores"))
    capsys.readouterr()
    assert command.main(["replay", *common, "--scores", str(tmp_path / "scores")]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 21
    assert command.main(["bench", *common, "-n", "1"]) == 0
    (tmp_path / "names").write_text("odo Quill")
    capsys.readouterr()
    assert command.main(["denylist", str(tmp_path / "names")]) == 0
    assert capsys.readouterr().out.split() == ["name", "odo", "quill"]
