from collections import Counter

import numpy as np
from fixtures_llm import SF, TEXTS, empty_docs, odd_docs, rows, table, words

from netspark.llm import quality_rules as Q
from netspark.llm.queries import QUERIES


def counted(text):
    w = words(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if words(line)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def failed(c):
    return c[0] < 50 or 100 * c[4] > 50 * c[0]


def test_query_equals_brute_force(spark):
    got = {r["doc_id"]: r for r in rows(QUERIES["op1_quality_rules"](spark, SF))}
    docs = table("documents")
    assert len(got) == len(docs)
    for d in docs:
        want, r = counted(d["text"]), got[d["doc_id"]]
        assert tuple(r[c] for c in Q.COUNTS[:5]) == want
        assert r["base_failed"] == failed(want)
        assert not (r["base_failed"] and r["kept"])
    labels = {r["doc_id"]: r["quality"] for r in table("labels")}
    judged = [(labels[i], r["kept"]) for i, r in got.items() if i in labels and not r["base_failed"]]
    assert sum(q == k for q, k in judged) >= 0.95 * len(judged)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    out = rows(Q.judge(docs.select("doc_id", "text", "n_words", "size")))
    assert len(out) == len(TEXTS)
    key = lambda x: str(x)
    assert sorted(((r["doc_id"], *(r["_q"][c] for c in Q.COUNTS[:5])) for r in out), key=key) == sorted(((i, *counted(t)) for i, t, _ in TEXTS), key=key)
    assert {r["n_words"] for r in out} == {"w"}
    assert rows(Q.judge(empty_docs(spark))) == []


def test_repeated_words_renumber_before_overflow():
    w = np.arange(3_000_000) % 2_500_000
    assert Q.repeated_words(w, 2_500_000) == 1_000_000
    assert Q.repeated_words(np.array([0, 0, 0, 0]), 1) == 4
    assert Q.repeated_words(np.array([0, 0, 0]), 1) == 0


def chance_good(model, pattern):
    """The posterior of one pattern, summed class by class."""
    p = np.array(model["share"], dtype=float)
    for k in range(len(p)):
        for j, v in enumerate(pattern):
            p[k] *= {-1: model["reject"][k, j], 1: 1 - model["reject"][k, j], 0: 1.0}[v]
    return p[0] / p.sum()


def test_em_weighs_rules_and_ignores_abstention():
    good, lone, odd, junk = [1, 1, 1, 0], [-1, 1, 1, 0], [0, 0, 0, 0], [1, -1, -1, 0]
    model = Q.fit_votes(np.array([good, lone, odd, junk]), np.array([900.0, 40.0, 30.0, 30.0]))
    assert model["kinds"] == [[1, 2]]
    assert chance_good(model, good) > 0.99 and chance_good(model, odd) > 0.9 and chance_good(model, junk) < 0.01
    assert chance_good(model, lone) > 0.9  # no other rule confirms rule 0


def planted(share, sensitive, wrong, n=100_000, seed=1):
    rng = np.random.default_rng(seed)
    bad = rng.random(n) < share
    votes = np.where(rng.random((n, len(wrong))) < np.where(bad[:, None], sensitive, wrong), -1, 1)
    votes[rng.random(votes.shape) < 0.1] = 0
    patterns, which, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    return bad, patterns, which.ravel(), counts.astype(float)


def test_planted_accuracies_are_found():
    for share, sensitive, wrong in [(0.2, [0.8, 0.7, 0.6, 0.9, 0.25, 0.05], [0.02, 0.05, 0.01, 0.1, 0.2, 0.05]),
                                    (0.1, [0.5, 0.5, 0.5, 0.5, 0.3, 0.3], [0.01, 0.02, 0.03, 0.05, 0.3, 0.1]),
                                    (0.4, [0.8, 0.7, 0.6, 0.9, 0.5, 0.5], [0.1, 0.05, 0.1, 0.1, 0.3, 0.5])]:
        bad, patterns, which, counts = planted(share, sensitive, wrong)
        model = Q.fit_votes(patterns, counts)
        assert len(model["kinds"]) == 1
        assert abs(model["share"][1] - share) < 0.05
        assert np.abs(model["reject"] - [wrong, sensitive]).max() < 0.05
        good = np.array([chance_good(model, p) for p in patterns])[which]
        rejected = (patterns == -1).any(axis=1)[which]
        assert ((good < 0.5) == bad).mean() > (rejected == bad).mean() + 0.1  # beats all-must-pass
        weak = [1] * 6
        weak[4] = -1  # one weak reject, many strong approvals
        assert chance_good(model, weak) > 0.9


def test_the_posterior_keeps_texts_that_one_rule_rejects(spark):
    """Kinds of junk of two rules each, and a rule that rejects some good texts at random."""
    rng = np.random.default_rng(3)
    kind = rng.choice(3, 20_000, p=[0.9, 0.06, 0.04])
    rate = np.array([[0.0005, 0.0005, 0.0005, 0.0005, 0.05], [0.99, 0.6, 0.0, 0.0, 0.05], [0.0, 0.0, 0.99, 0.9, 0.05]])
    votes = np.where(rng.random((len(kind), 5)) < rate[kind], -1, 1)
    patterns, which, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = Q.fit_votes(patterns, counts.astype(float))
    assert model["kinds"] == [[0, 1], [2, 3]]
    good = np.array([chance_good(model, p) for p in patterns])[which.ravel()]
    assert ((good >= 0.5) == (kind == 0)).mean() > 0.995
    assert chance_good(model, [1, 1, 1, 1, -1]) > 0.99 and chance_good(model, [-1, 1, 1, 1, 1]) < 0.5
    assert Q.fit_votes(np.array([[1, 1], [-1, 1]]), np.array([9.0, 1.0]))["kinds"] == []


def test_the_fit_does_not_move_with_size():
    _, patterns, _, counts = planted(0.2, [0.8, 0.7, 0.6, 0.9, 0.25, 0.05], [0.02, 0.05, 0.01, 0.1, 0.2, 0.05])
    small, large = Q.fit_votes(patterns, counts), Q.fit_votes(patterns, counts * 1e6)
    assert np.abs(small["reject"] - large["reject"]).max() < 1e-4 and small["kinds"] == large["kinds"]


def test_column_equals_the_posterior_by_classes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("_q", Q.features("text"))
    model = Q.fit(docs)
    got = docs.select(*[c.alias(n) for n, c in Q.rules("_q").items()], Q.posterior(model).alias("good")).collect()
    for r in got:
        assert abs(r["good"] - chance_good(model, r[:-1])) < 1e-9


def test_input_columns_of_reserved_names_are_replaced(spark):
    from netspark.llm import pii_crf, secret_scan
    docs = spark.createDataFrame([(1, "mail a.b@c.org", "x", "x", "x", "x")], "doc_id bigint, text string, _q string, _verdict string, _pii string, _secrets string")
    (judged,), (found,), (secret,) = rows(Q.judge(docs)), rows(pii_crf.scan(docs)), rows(secret_scan.scan(docs))
    assert judged["_q"]["n_words"] == 2 and judged["_verdict"]["base_failed"] and judged["_pii"] == "x"
    assert found["_pii"][0]["start"] == 5 and found["_q"] == "x" and secret["_secrets"] == [] and secret["_pii"] == "x"
