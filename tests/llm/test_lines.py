import corpus_pipeline as C


def test_lines_that_many_texts_share_go(spark, sf):
    own = lambda i: "\n".join(f"A line of document {i} alone, number {k}." for k in range(4))
    rows = []
    for i in range(400):  # 20 sources; as in the tables, no line comes near half of a source
        lines = own(i).split("\n")
        if i % 8 == 0:
            lines.insert(2, " Shared by an eighth of all. ")
        if i % 20 == 3 and i < 240:
            lines.append("Shared in one source.")
        if i % 50 == 0:
            lines.insert(0, "In eight texts only.")
        rows.append((i, "\n".join(lines), f"s{i % 20}"))
    rows += [(1000 + i, "Copied often.\n" + own(1000), "s1") for i in range(30)]
    rows += [(2000 + i, "\n".join([f"Its own {i}."] + [f"A long line of a text that has many near copies, number {k}." for k in range(5)]), "s2") for i in range(30)]
    rows += [(3000, None, None), (3001, "", None)]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "en") for r in rows], "doc_id long, text string, source string, n_chars long, lang string")
    got = {r.doc_id: r for r in C.line_dedup(spark, docs, sf).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        want = "\n".join(x for x in text.split("\n") if not x.strip().startswith("Shared")) if text else text
        assert got[i].text == want and got[i].n_chars == len(want or "")
    assert C.line_dedup(spark, docs.limit(0), sf).count() == 0
