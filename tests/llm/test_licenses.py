import re

from logloom.llm import licenses as L


def brute(text):
    """The base columns, straight from the contract's words."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    starts, labels = [], set()
    for phrase, label in {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}.items():
        own = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(own)] == own:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_base_columns_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in L.scan(docs).collect()}
    assert got == want


def test_rules_and_suppression():
    assert len(L.rules()) > 200
    labels = lambda t: L.scan_text(t)["labels"].split(",")
    assert labels("Licensed under the GNU General Public License, version 2 or any later version.") == ["gpl", "gpl-2-or-later"]
    assert labels("Released under the MIT License.") == ["mit"]
    assert labels("Apache License, Version 2.0") == ["apache-2.0"]
    assert labels("CC BY-SA 4.0") == ["cc-by", "cc-by-sa-4.0"]
    assert labels("Copyright 2020 Example. All Rights Reserved.") == ["reserved"]
    assert L.scan_text("plain words only")["labels"] == ""
    found = L.detections(L.words_of("GNU Lesser General Public License version 2.1"))
    assert [x[0] for x in found] == ["lgpl-2.1"]
    assert L.scan_text("cc by cc by")["n_base"] == 2


def test_suppression_equals_the_pairwise_rule(spark, sf):
    for r in spark.read.parquet(f"{sf}/documents.parquet").limit(100).collect():
        words = L.words_of(r.text + " GNU General Public License v3 or later, all rights reserved; CC BY 4.0 mit license")
        everything = [(m.start(), m.end(), p, i, label) for k, own in L.compiled() if k in words for i, label, p, e in own for m in e.finditer(words)]
        inside = lambda a, b: b[0] <= a[0] and a[1] <= b[1] and (-b[2], b[0] - b[1], b[3]) < (-a[2], a[0] - a[1], a[3])
        assert sorted(L.detections(words)) == sorted((x[4], x[2], x[0], x[1]) for x in everything if not any(inside(x, y) for y in everything))


def test_defined_results(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (1, "CC BY " * 30000)], "doc_id long, text string")
    got = sorted(L.scan(docs).collect(), key=lambda r: r.n_words)
    assert [r.n_base for r in got] == [0, 0, 30000] and got[0].first_word is None and got[0].score == 0
    assert got[2].last_word == 59998
    assert L.scan(docs.limit(0)).count() == 0


def test_clashing_names_repeats_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "MIT License", 1, "x"), (None, "MIT License", 2, "y")], "doc_id long, text string, score int, labels string")
    got = L.scan(docs).collect()
    assert [(r.doc_id, r.labels) for r in got] == [(None, "mit")] * 2
