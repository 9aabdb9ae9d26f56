import re

import pytest
from fixtures_llm import SF, TEXTS, empty_docs, odd_docs, rows, table

from netspark.llm import license_scan as S
from netspark.llm.queries import QUERIES


def normal_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def base(w):
    hits = []
    for phrase, label in S.BASE:
        p = phrase.split()
        hits += [(i, label) for i in range(len(w)) if w[i:i + len(p)] == p]
    return hits


def surviving(w):
    text = " " + " ".join(w) + " "
    found = []
    for rule, label, key, regex, tier in S.signatures():
        if f" {key} " in text:
            for m in re.finditer(regex, text):
                found.append((text[:m.start()].count(" ") - 1, text[:m.end()].count(" "), tier, rule, label))
    keep = []
    for d in found:
        inside = [e for e in found if e != d and e[0] <= d[0] and e[1] >= d[1] and e[2] <= d[2] and ((e[0], -e[1], e[2], e[3]) < (d[0], -d[1], d[2], d[3]))]
        if not inside:
            keep.append(d)
    return keep


EXTRA = [
    (20, "Licensed under CC BY-NC 4.0. Also CC-BY, cc by cc by; GNU General Public License, version 2 or later.", "s"),
    (21, "GNU Lesser General Public License v2.1; Apache License, Version 2.0; apache-2.0 and the Apache Software License", "s"),
    (22, "Permission is hereby granted, free of charge, to any person obtaining a copy. ALL RIGHTS RESERVED all rights reserved", "s"),
    (23, "Creative Commons Attribution-ShareAlike 3.0 Creative Commons Attribution ShareAlike license BSD 3-Clause License 2-clause BSD", "s"),
    (24, "MIT " * 50 + "the mit license " * 400, "s"), (25, "İ cc by É general public licensé", "s"), (25, "cc by", "s"), (25, "cc by", "s"),
]


def check(out, texts):
    want = []
    for i, t in texts:
        w = normal_words(t)
        b = base(w)
        d = surviving(w)
        want.append(str((i, len(w), len(b), min((x[0] for x in b), default=None), max((x[0] for x in b), default=None), sorted({x[1] for x in b}),
                         sorted({x[1] for x in b} | {x[4] for x in d}))))
    got = []
    for r in out:
        labels = {x["label"] for x in r["base"]}
        starts = [x["start"] for x in r["base"]]
        got.append(str((r["doc_id"], r["n_words"], len(starts), min(starts, default=None), max(starts, default=None), sorted(labels), sorted(labels | set(r["found_labels"])))))
        assert 0 <= r["score"] <= 1
    assert sorted(got) == sorted(want)


def test_odd_rows(spark):
    texts = TEXTS + EXTRA
    check(rows(S.label_documents(odd_docs(spark, texts))), [(i, t) for i, t, _ in texts])
    assert rows(S.label_documents(empty_docs(spark))) == []


def test_query(spark):
    out = {r["doc_id"]: r for r in rows(QUERIES["op7_license_scan"](spark, SF))}
    assert len(out) == len(table("documents"))
    for d in table("documents"):
        w, r = normal_words(d["text"]), out[d["doc_id"]]
        b = base(w)
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(b), ",".join(sorted({x[1] for x in b})))
        assert (r["first_word"], r["last_word"]) == (min((x[0] for x in b), default=None), max((x[0] for x in b), default=None))
        assert r["labels"] == ",".join(sorted({x[1] for x in b} | {x[4] for x in surviving(w)}))


def test_rules_are_many_and_all_compile():
    rules = S.signatures()
    assert len(rules) >= 200 and [r[0] for r in rules] == list(range(len(rules)))
    for _, label, key, regex, tier in rules:
        re.compile(regex)
        assert tier in S.SCORES and label and key == key.lower()


@pytest.mark.parametrize("text, label", [("MIT License", "mit"), ("GPL-3.0-only", "gpl-3"), ("CC0 1.0 Universal", "cc0-1.0"), ("cc by sa 4 0", "cc-by-sa-4.0"), ("New BSD License", "bsd-3-clause")])
def test_names(text, label):
    assert label in {d[4] for d in surviving(normal_words(text))}


def samples(parsed):
    """Texts a pattern matches: every alternative, every optional part with and without, repeats once and twice at most."""
    out = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            some = [chr(arg)]
        elif name == "IN":
            some = ["x", "0"] if str(arg[0][0]) == "CATEGORY" else [chr(v if str(k) == "LITERAL" else v[0]) for k, v in arg]
        elif name == "NOT_LITERAL":
            some = ["x"]
        elif name == "SUBPATTERN":
            some = samples(arg[3])
        elif name == "BRANCH":
            some = [x for branch in arg[1] for x in samples(branch)]
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, part = arg
            one = samples(part)
            some = [x * k for x in one for k in sorted({low, min(int(high), low + 1)})]
        else:
            assert name in ("ASSERT", "ASSERT_NOT"), name
            some = [""]
        out = [a + b for a in out for b in dict.fromkeys(some)]
    return out


def matched(w, rules):
    """Rules by their matches in a normal text, without any gate."""
    text = " " + " ".join(w) + " "
    return {(m.start(), m.end(), i) for i, _, _, regex, _ in rules for m in re.finditer(regex, text)}


def test_every_match_holds_the_keyword():
    for rule in S.signatures():
        for text in samples(re._parser.parse(rule[3])):
            assert matched(text.split(" "), [rule]), (rule, text)
            assert f" {rule[2]} " in f" {text} ", (rule, text)


NAME = "the " + "very " * 60 + "long named university of x nor y"


def test_gate_drops_nothing(spark):
    """Texts that match one rule each, alone, as the query finds them and as the rules do without the gate."""
    texts = [samples(re._parser.parse(r[3]))[-1] for r in S.signatures()]
    texts += ["May not be reproduced without prior written permission.", "FreeBSD License", "see the LICENCE file", "see LICENSE", "may not be copied", "licence",
              f"Neither the name of {NAME} nor the names of its contributors may be used to endorse",
              "neither the name of a neither the name of b nor the names of its contributors may be used to endorse x",
              "neither the name of nor the names of its contributors may be used to endorse", "neither the name of x. " * 5000]
    docs = odd_docs(spark, [(i, t, "s") for i, t in enumerate(texts)])
    found = docs.select("doc_id", S.detections(S.normal(docs["text"])).alias("d")).collect()
    for r in found:
        w = normal_words(texts[r["doc_id"]])
        text = " " + " ".join(w) + " "
        want = {(text[:a].count(" ") - 1, text[:b].count(" "), i) for a, b, i in matched(w, S.signatures())}
        assert {(d["start"], d["end"], d["rule"]) for d in r["d"]} == want, texts[r["doc_id"]][:80]
    labels = {r["doc_id"] - len(S.signatures()): {d["label"] for d in r["d"]} for r in found}
    assert [sorted(labels[i]) for i in range(10)] == [["proprietary"], ["bsd-2-clause"], ["licensed"], ["licensed"], [], [], ["bsd-3-clause"], ["bsd-3-clause"], [], []]
