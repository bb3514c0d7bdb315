import hashlib
import io
import zlib

import duckdb

from logloom.llm import lines as L
from logloom.llm import warc as W


def test_warc_equals_plain_rules(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    last = {}
    for page_id, payload in rows:
        last[payload] = max(page_id, last.get(payload, page_id))
    want = []
    for page_id, payload in rows:
        again = len(payload) >= 1000 and last[payload] != page_id
        want.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", last[payload] if again else None))
    got = [tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in W.op8_warc(spark, sf).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_monolith_becomes_members(spark, tmp_path):
    made = [W.record(i, f"http://e.example/{i}\n", b"p" * i * 999, "d", None, False) for i in range(200)]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    whole = b"".join(pack.compress(x) for x in made) + pack.flush()
    assert [data for _, data in W.records(io.BytesIO(whole))] == made
    (tmp_path / "x.warc.gz").write_bytes(whole)
    out = W.normalise(spark.createDataFrame([(str(tmp_path / "x.warc.gz"),)], "path string")).first()
    assert out.n_records == 200
    import json

    for entry, data in zip(map(json.loads, open(out["index"].removeprefix("file:"))), made):
        assert W.lookup(out.path, entry["offset"], entry["length"]) == data


def test_warc_defined_results(spark):
    big = "x" * 5000
    pages = spark.createDataFrame([(1, None, None, 1), (None, "u", big, 2), (7, "u", big, 3), (7, "u", big, 4), (2, "é x", big, 5)], "page_id long, url string, html string, digest int")
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in W.read(W.normalise(W.write(pages))).collect()), key=str)
    assert got == sorted([(1, "response", None, 0), (None, "revisit", 7, 5000), (7, "response", None, 5000), (7, "response", None, 5000), (2, "revisit", 7, 5000)], key=str)
    assert W.read(W.normalise(W.write(pages.limit(0)))).count() == 0


def test_boilerplate_lines(spark):
    rows = [(i, "h", ["menu", f"own {i}", " menu ", ""]) for i in range(12)] + [(99, "h", ["menu"]), (50, None, ["menu"]), (51, "few", ["menu", "x"])]
    pages = spark.createDataFrame(rows, "id long, host string, lines array<string>").selectExpr("named_struct('id', id) as row", "host", "lines")
    got = {r.row.id: (r.kept, r.n_dropped, r.host_pages) for r in L.cleaned(pages).collect()}
    assert got[0] == (["own 0", ""], 2, 13)
    assert got[99] == (["menu"], 0, 13) and got[50] == (["menu"], 0, 1) and got[51] == (["menu", "x"], 0, 1)
    assert L.cleaned(pages.limit(0)).count() == 0


def test_op10_on_odd_pages_equals_sql(spark, tmp_path):
    page = lambda own: f"<p>Menu</p><p>{own}</p>\n<br> Menu <i>Foot</i>"
    rows = [(i, f"http://A.example/{i}", page(f"own {i}"), 1) for i in range(6)]
    rows += [(20, "http://a.example/x", None, 1), (21, "http://a.example/y", "", 1), (22, None, page("no url"), 1), (23, "http://a.example/z", "Menu", 1), (5, "http://A.example/5", page("own 5"), 1)]
    rows += [(30 + i, f"http://three.example/{i}", page(f"one of three {i}"), 1) for i in range(3)] + [(40 + i, f"http://two.example/{i}", page(f"of two {i}"), 1) for i in range(2)]
    rows += [(50, "http://a.example/long", "<p>Menu</p>" + "".join(f"<p>line {i}</p>" for i in range(30_000)), 1)]
    spark.createDataFrame(rows, "page_id long, url string, html string, host int").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    cur = con.execute(L.OP10_SQL)
    names = [d[0] for d in cur.description]
    out = L.op10_line_dedup(spark, str(tmp_path))
    got = sorted((tuple(r[n] for n in names) for r in out.collect()), key=repr)
    assert got == sorted(cur.fetchall(), key=repr)
    by_id = {r.page_id: r for r in out.collect()}
    assert by_id[0].text == "own 0" and by_id[31].text == "one of three 1" and by_id[40].n_dropped == 0 and by_id[23].text == "Menu" and by_id[50].n_dropped == 1


def test_a_very_long_page(spark):
    long = "".join(f"<p>line {i}</p>" for i in range(150_000))
    pages = spark.createDataFrame([(1, "http://a.example", long, 1), (2, "http://a.example", long, 1)], "page_id long, url string, html string, refers_to int")
    got = sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in W.read(W.normalise(W.write(pages))).collect())
    assert got == [(1, "revisit", 2, len(long)), (2, "response", None, len(long))]
