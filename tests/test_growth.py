"""Steps that have to stay bounded where tables grow: what is broadcast, what is read as one row, what meets how often."""

from pyspark.sql import functions as F

from logloom.functions.gates import folded, may_have
from logloom.functions import patterns as P
from logloom.operators import labels, retention, sessions, usage
from logloom.plans import queries
from logloom.sources import sessions as source


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def session_tables(spark):
    calls = [(f"s{i % 2}", i // 2, i // 2, f"c{i}", "Bash", '{"file_path":"/w/part1.txt"}', "a line of more than forty characters in all here\n" * 3, False, i // 2 + 1, "t", "said", "/w/part1.txt") for i in range(40)]
    c = spark.createDataFrame(calls, "session_id string, call_pos int, call_index int, id string, tool string, input_json string, result string, is_error boolean, text_index int, ts string, narration string, target string")
    return c, c.select("session_id", F.col("call_pos").alias("text_index"), F.col("result").alias("body"))


def test_exploded_keys_are_not_broadcast(spark, tmp_path):
    calls, texts = session_tables(spark)
    calls.write.parquet(str(tmp_path / "calls"))
    texts.write.parquet(str(tmp_path / "texts"))
    c, x = (spark.read.parquet(str(tmp_path / n)) for n in ("calls", "texts"))
    out = labels.weak_labels(c, x, 0)
    assert "BroadcastExchange" not in plan(out)
    assert {(r.label, r.kind) for r in out.collect()} == {(1, "gold"), (0, "proxy")}


def test_quotes_meet_by_any_start(spark):
    """Lines that begin inside words of a text, without a space among their first characters, or with one."""
    text = "xx" + "abcdefghij" * 6 + " and then some plain words follow it up to the end of this texté\U0001f600 " + "q" * 50
    rows = [("s", text[i : i + n]) for i in range(0, len(text) - 41) for n in (41, 60) if i + n <= len(text)]
    lines = spark.createDataFrame(sorted(set(rows)) + [("s", "z" + text[:50]), ("t", text[:50])], "session_id string, line string")
    got = labels.last_quotes(lines, spark.createDataFrame([("s", 3, text), ("s", 5, "no " * 30), ("s", 7, "u " + text)], "session_id string, text_index int, body string")).collect()
    assert sorted(r.line for r in got) == sorted({x for _, x in rows}) and {r.last_text for r in got} == {7}


def test_files_are_read_in_parts(spark, tmp_path):
    """A part has a few bytes only; lines have the order, and the numbers, that they have in the whole file."""
    (tmp_path / "a b+c%d.jsonl").write_bytes(('{"a":1}\r\n\n{"b":"x "}\n{"c":2}\x0b{"d":3}\n' * 9 + '{"e":1}\r').encode())
    (tmp_path / "s2.jsonl").write_bytes(b'{"a":"\xff"}\n' * 30)
    whole = source.session_lines(source.session_files(spark, str(tmp_path), 1)).select("session_id", "line_no", F.to_json("record").alias("r")).orderBy("session_id", "line_no").collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60")
    try:
        parts = source.session_records(spark, str(tmp_path), 1).select("session_id", "line_no", F.to_json("record").alias("r")).orderBy("session_id", "line_no").collect()
        assert len({r.line_no.part for r in parts}) > 3 and [(r.session_id, r.r) for r in parts] == [(r.session_id, r.r) for r in whole]
        last = {r.session_id: (r.n_records, r.last_line) for r in source.last_records(spark, str(tmp_path), 1).collect()}
        assert last == {s: (sum(r.session_id == s for r in whole), max(r.line_no for r in whole if r.session_id == s)) for s in ("a b+c%d", "s2")}
        assert source.session_records(spark, str(tmp_path), 1, without="b+c").select("session_id").distinct().count() == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_common_tokens_meet_in_order(spark):
    """A token of all rows and all events: the join of both would have 40,000 rows."""
    n = 200
    found = spark.createDataFrame([("s", "tok_1/xy", i, "agent" if i % 3 == 0 else "tool") for i in range(n)], "session string, token string, pos long, kind string")
    tokens = spark.createDataFrame([("s", "tok_1/xy", i, i + k) for i in range(n) for k in (1, 4)] + [("s", "never_1/", 5, 9)], "session string, token string, start long, now long")
    out = usage.classified(tokens, found)
    assert "Join" not in plan(out)
    got = {(r.token, r.start, r.now): (r.use, r.proven) for r in out.collect()}
    for (token, start, now), (use, proven) in got.items():
        seen = [(p, p % 3 == 0) for p in range(n)] if token == "tok_1/xy" else []
        own = any(a and start <= p < now for p, a in seen)
        first = min((p for p, a in seen if a and p >= now), default=None)
        tool = min((p for p, a in seen if not a and p >= start), default=None)
        want = None if first is None else "own" if own else "recarried" if tool is not None and tool < first else "fresh"
        assert (use, proven) == (want, own)
    assert len(got) == 2 * n + 1 and {v[0] for v in got.values()} >= {None, "own", "recarried"}


def test_tokens_within_runs_of_their_session(spark):
    runs = spark.createDataFrame([("s", 1, "plainword_1"), ("s", 2, "xplainword_1y"), ("t", 3, "plainword_1")], "session string, pos int, run string")
    wanted = spark.createDataFrame([("s", "plainword_1")], "session string, token string")
    assert sorted(r.pos for r in usage.met(wanted, runs, "pos").collect()) == [1, 2]


def test_quoted_lines_shuffle_no_words(spark, sf):
    assert "Exchange hashpartitioning" not in plan(queries.quoted_lines(spark, sf))


def test_gates_let_all_through(spark):
    """Texts that the three long patterns match pass their gates, in any case and behind digits."""
    topics = "Fakturace|VYÚČTOVÁNÍ|naúčtovat|účtenka|účtování|účetní|idoklad|fakturoidem|ISDOC|invoices|billing|ičo|DIČ|dph|iban|ſwift|číslo  účtu|VAT|daní|daně|daňová|smlouva|smluvní|contracts|NDA|gdpr|dpo|obchodní podmínky|zpracování osobních|osobních údajů|rodné číslo|narozena|telefonu|ceníky|cenový|cena|cenách|KČ|czk|50 eur|7usd|platby|platební|předplatné|tarify|provize|mzda|výplata|odměna|Kredity|credit|credits|subscription|refunds|payout|pricing|revenue|salary|payroll|stripe|paypal|gopay|comgate|klienti|zákazníci|nabídka|nabídnout|poptávka|objednávka|obchodník|prodejna|tržby|marže|zisky|rozpočty|rozpočet|investoři|investİce|investice|strategie|roadmaps|konkurence|competitors|pitch_deck|yc|y-combinator|fundraising|valuations|konverzní|\u212aredit".split("|")
    cases = [("topic", P.SENSITIVE, t) for t in topics]
    cases += [("security finding", P.DROP_ROWS["security finding"], t) for t in "SSRF|xss|csrf|rce|sqli|sql \n injection|idor|lfi|CVE-2024|vulnerable|zranitelnost|exploits|pentests|penetration tests|security  audits|security\tissue|bezpečnostní díry|bezpečnostní chyba".split("|")]
    cases += [("machine inventory", P.DROP_ROWS["machine inventory"], t) for t in "tailscale  status|ip addr|ip\tlink|ifconfig|NMCLI|printenv|hostnamectl|arp -a|ss -tl|ss  -n|netstat|lsusb|lspci|dmidecode|/etc/hosts|x/.ssh/id".split("|")]
    rows = spark.createDataFrame([(g, p, f"{a}{t}{b}") for g, p, t in cases for a, b in (("", ""), ("é ", "."), ("1", " 2"), ("_", "\n"))], "gate string, p string, text string")
    for g, p in {(g, p) for g, p, _ in cases}:
        own = rows.where(F.col("gate") == g).select("text", F.col("text").rlike(P.regex(p)).alias("hit"), may_have(g, folded(F.col("text"))).alias("gate"))
        out = own.collect()
        assert [r.text for r in out if r.hit and not r.gate] == [] and sum(r.hit for r in out) > len(out) // 4
        assert spark.range(1).select(may_have(g, F.lit("nothing of that kind stands here"))).first()[0] is False


def test_strings_without_json(spark):
    rows = spark.createDataFrame([(("a", ["x", None], [("q", 3)], None), "w", 1.5), (None, None, None)], "s struct<b: string, c: array<string>, d: array<struct<e: string, n: int>>, f: string>, t string, n double").coalesce(1)
    own = [sessions.strings_in(F.col(f.name), f.dataType, F.lit(f.name)) for f in rows.schema]
    got = {(r.path, r.value) for r in rows.select(F.inline(F.concat(*own))).collect()}
    json = sessions.strings_of(rows.select(F.monotonically_increasing_id().alias("id"), F.to_json(F.struct("*")).alias("j")), "id", "j").collect()
    assert got == {(r.path, r.value) for r in json} == {("s.b", "a"), ("s.c[0]", "x"), ("s.d[0].e", "q"), ("t", "w")}
    assert sessions.strings_in(F.col("x"), spark.range(1).select(F.current_date()).schema[0].dataType) is None


def test_scores_are_bound_once(spark):
    """The character scores stand in the plan once, so they are not made anew for each line."""
    scores = F.transform(F.sequence(F.lit(0), F.length("t") - 1), lambda i: (i % 7).cast("double"))
    rows = spark.createDataFrame([("ab\n\ncde\nf",)], "t string").select(retention.line_scores(F.split("t", "\n"), scores).alias("m"))
    assert plan(rows).count("% 7") == 1 and rows.first().m == [0.5, None, 5.0, 1.0]
