import random
import re._parser as parser

from logloom.llm import licenses as L


def example(nodes, rng):
    """A text that an expression matches, with its choices made at random."""
    out = ""
    for op, value in nodes:
        name = str(op)
        if name == "LITERAL":
            out += chr(value)
        elif name == "IN":
            kind, what = rng.choice(value)
            out += chr(what) if str(kind) == "LITERAL" else rng.choice("0123456789") if str(what) == "CATEGORY_DIGIT" else "w"
        elif name == "MAX_REPEAT":
            low, high, inner = value
            out += "".join(example(inner, rng) for _ in range(rng.randint(low, min(high, low + 3))))
        elif name == "BRANCH":
            out += example(rng.choice(value[1]), rng)
        elif name == "SUBPATTERN":
            out += example(value[-1], rng)
        else:
            raise ValueError(name)
    return out


def test_every_rule_fires_on_what_it_matches_and_its_keyword_lets_it():
    rng = random.Random(4)
    by_rule = {i: pattern for _, own in L.compiled() for i, _, _, pattern in own}
    for i, rule in enumerate(L.rules()):
        for _ in range(12):
            text = example(parser.parse(rule.pattern), rng)
            words = L.words_of(text)
            assert rule.keyword in words, (rule, text)
            assert by_rule[i].search(words), (rule, text)
            assert any(label for label, *_ in L.detections(words)), (rule, text)


def test_most_rules_are_written():
    assert len(L.WRITTEN) + len(L.CLAUSES) >= 200 and len(L.rules()) >= 450
    assert all(rule.keyword.decode() == " ".join(rule.keyword.decode().split()) for rule in L.rules())


def test_keywords_let_every_branch_through():
    labels = lambda t: L.scan_text(t)["labels"].split(",")
    assert labels("Unauthorized copying of this file is strictly prohibited") == ["proprietary"]
    assert labels("Unauthorised redistribution is prohibited") == ["proprietary"]
    assert labels("It may not be redistributed") == ["proprietary"]
    assert "apache-2.0" in labels("You may not use this file except in compliance with the Licence")
    assert labels("Llama 3 Community Licence") == ["llama-community"]
