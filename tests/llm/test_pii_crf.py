import hashlib
import re

import numpy as np
from fixtures_llm import LONG, SF, TEXTS, empty_docs, odd_docs, rows, table

from netspark.llm import pii_crf as P
from netspark.llm.queries import QUERIES


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(d):
    total = 0
    for i, c in enumerate(d[::-1]):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


BASE = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True), (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda x: 14 <= len(digits(x)) <= 19 and luhn(digits(x))), (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 10 <= len(digits(x)) <= 15)]


def expected(text):
    return sorted((m.start(), k, m.end()) for k, (p, keep) in enumerate(BASE) for m in re.finditer(p, text or "") if keep(m[0]))


EXTRA = [
    "a@b.cc_d@e.f x@y @z.w a@@b.c a@b.c@d.e.f %+-@-.- é@x.y a@b.c.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3 999.1.2.3.4 1..2.3.4", "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111111111111",
    "4111  1111 1111 1111 5 - 6 4012888888881881 4012888888881882", "+1 (017) 555-7713 +44 20 7946 0958. +1 +2 +123456789012345678 + 12 +1234567890 190.137.2.4", "", "+" * 500 + "1" * 30, "@" * 500, "a" * 5000 + "@", "1" * 5000]


def test_base_spans():
    for text in EXTRA + [t for _, t, _ in TEXTS if t and len(t) < 10_000] + [d["text"] for d in table("documents")]:
        assert P.base_spans(text) == expected(text), text[:80]


def test_long_runs_stay_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1 " * 150_000, "1." * 150_000, "+1" + "." * 300_000, "a@" * 150_000, "a@b-" * 80_000, "." * 300_000):
        P.base_spans(text)


def test_query(spark):
    got = {r["doc_id"]: r for r in rows(QUERIES["op2_pii_crf"](spark, SF))}
    docs = table("documents")
    assert len(got) == len(docs)
    line = lambda spans: ",".join(f"{P.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    for d in docs:
        base, r = expected(d["text"]), got[d["doc_id"]]
        assert [r[f"n_{k}"] for k in P.KINDS] == [sum(s[1] == k for s in base) for k in range(4)]
        assert r["base_sha256"] == hashlib.sha256(line(base).encode()).hexdigest()
        assert set(filter(None, line(base).split(","))) <= set(r["spans"].split(","))


def corpus():
    """Phones and addresses, some of whose repeats the base patterns miss."""
    rng = np.random.default_rng(2)
    out = []
    for i in range(300):
        a, b = rng.integers(100, 999), rng.integers(1000, 9999)
        out.append(f"word word +1 (017) {a}-{b} more words then {a}-{b} and 12 of 4.0 items in 2024 word" if i % 2 else f"mail to user{i}.x{a}@mail{b}.example.com word word version 4.0 word")
    return out


def test_related_tokens_take_the_label(spark):
    texts = corpus()
    model = P.fit(odd_docs(spark, [(i, t, "s") for i, t in enumerate(texts)]))
    text = "ask +1 (017) 482-9931 today word word 482-9931 again, version 4.0 of 12"
    spans = P.find(text, model)
    assert [(text[a:b], P.KINDS[k], base) for a, k, b, base in spans] == [("+1 (017) 482-9931", "phone", True), ("482-9931", "phone", False)]
    plain = "version 4.0 of 12 items in 2024, see 3.5 or 7"
    assert P.find(plain, model) == []


def test_messages_agree_with_enumeration():
    rng = np.random.default_rng(0)
    g = P.Graph("x 1 2 w 3 1234567 q 1234567", [])
    n = len(g.places)
    assert g.chain == [(0, 1), (2, 3)] and g.skips == [(3, 4)]
    k = len(P.LABELS)
    model = {"shapes": {s: rng.normal(size=k) for s in g.shapes}, "unseen": np.zeros(k), "chain": rng.normal(size=(k, k)), "skip": rng.normal(size=(k, k))}
    model["skip"] += model["skip"].T
    own = np.stack([model["shapes"][s] for s in g.shapes])
    left, right = {1, 3}, {0, 2}
    want = np.zeros((n, k))
    for y in np.ndindex(*[k] * n):
        score = sum(own[i, y[i]] + (i not in left) * model["chain"][0, y[i]] + (i not in right) * model["chain"][y[i], 0] for i in range(n))
        score += sum(model["chain"][y[i], y[j]] for i, j in g.chain) + sum(model["skip"][y[i], y[j]] for i, j in g.skips)
        for i in range(n):
            want[i, y[i]] += np.exp(score)
    want /= want.sum(axis=1, keepdims=True)
    # Without loops message passing is exact.
    assert np.abs(P.posteriors(g, model) - want).max() < 1e-3


def test_odd_rows(spark):
    texts = TEXTS + [(20 + i, t, "s") for i, t in enumerate(EXTRA)] + [(50, LONG + " a@b.cc", "s"), (21, EXTRA[1], "s")]
    out = rows(P.scan(odd_docs(spark, texts)).select("doc_id", "text", "_pii"))
    assert sorted(str((r["doc_id"], r["text"])) for r in out) == sorted(str((i, t)) for i, t, _ in texts)
    for r in out:
        assert [(s["start"], s["kind"], s["end"]) for s in r["_pii"] if s["base"]] == expected(r["text"])
    assert rows(P.scan(empty_docs(spark))) == []


def test_label_reaches_every_repeat(spark):
    model = P.fit(odd_docs(spark, [(i, t, "s") for i, t in enumerate(corpus())]))
    text = "ask +1 (017) 482-9931 today" + " word word 482-9931 again" * 300
    found = P.find(text, model)
    assert [(text[a:b], P.KINDS[k], base) for a, k, b, base in found] == [("+1 (017) 482-9931", "phone", True)] + [("482-9931", "phone", False)] * 300


def test_long_path_agrees_with_passes_in_order():
    rng = np.random.default_rng(1)
    g = P.Graph(" w ".join(["1234567"] * 101), [])
    k = len(P.LABELS)
    model = {"shapes": {}, "unseen": np.zeros(k), "chain": np.zeros((k, k)), "skip": 6 * np.eye(k)}
    g.labels[0] = 3
    g.shapes = list(range(101))
    model["shapes"] = {s: rng.normal(size=k) for s in g.shapes}
    assert g.skips == [(i, i + 1) for i in range(100)]
    own = np.exp(np.stack([model["shapes"][s] for s in g.shapes]))
    own[0] = np.eye(k)[3]
    table = np.exp(model["skip"])
    ahead, back = np.ones((101, k)), np.ones((101, k))
    for i in range(1, 101):
        ahead[i] = (ahead[i - 1] * own[i - 1]) @ table
        ahead[i] /= ahead[i].sum()
        back[100 - i] = table @ (back[101 - i] * own[101 - i])
        back[100 - i] /= back[100 - i].sum()
    want = own * ahead * back
    assert np.abs(P.posteriors(g, model) - want / want.sum(axis=1, keepdims=True)).max() < 1e-3


def grouped():
    """Phones and cards in groups, labelled once and repeated in forms that the base patterns miss."""
    rng = np.random.default_rng(3)
    out = []
    for i in range(300):
        a, b, c = rng.integers(20, 99), rng.integers(1000, 9999), rng.integers(1000, 9999)
        phone = f"+44 {a} {b} {c} and later +44 {a} {b} {c} word"
        phone += f" word +1 2{a} {b // 10} {c} word"
        out.append([phone + f" 0{a} {b} {c} word", phone + " call 12 of 40", "about 2024 items of 100 at 4.0 word 12 of 300 word"][i % 3])
    return out


def test_numbers_in_groups_take_the_label(spark):
    model = P.fit(odd_docs(spark, [(i, t, "s") for i, t in enumerate(grouped())]))
    text = "call +44 20 7946 0958 today, or 020 7946 0958. word 7946 0958 again, 12 of 300 items in 2024"
    found = [(text[a:b], P.KINDS[k], base) for a, k, b, base in P.find(text, model)]
    assert found == [("+44 20 7946 0958", "phone", True), ("020 7946 0958", "phone", False), ("7946 0958", "phone", False)]
    assert P.find(text[text.index("020 7946"):], model) == []


def test_links_of_groups_and_short_tokens():
    text = "card 4539 1488 0343 6467 word 4539  1488  0343  6467 word 45-39 x9 12"
    g = P.Graph(text, P.base_spans(text))
    word = [text[a:b] for a, b in g.places]
    links = {(i, j) for i, j in g.skips} | {(i, j) for i, j, _ in g.repeats}
    assert {(0, 4), (1, 5), (2, 6), (3, 7)} <= {(i, j) for i, j in links}
    assert all(word[i] == word[j] for i, j in links) and len(links) == len(set(links))
    assert not links & set(g.chain)
    text = "+44 20 7946 0958 or 020 7946 0958 and +442079460958"
    g = P.Graph(text, [(0, 3, 16)])
    assert {(1, 4), (2, 5), (3, 6), (6, 7)} <= set(g.skips)
    # Without a labelled token, short tokens are not related.
    assert P.Graph("v 12 w 12 w 2024 w 2024", []).repeats == []


def test_runs_of_numbers_stay_linear():
    for text in ("1 " * 50_000, "12 x " * 50_000, "+44 20 7946 0958 " * 10_000):
        g = P.Graph(text, P.base_spans(text))
        assert sum(len(nodes) for _, nodes in g.paths) <= 25 * len(g.places)
