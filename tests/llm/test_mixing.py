from collections import defaultdict

import pytest
from fixtures_llm import SF, TEXTS, empty_docs, odd_docs, rows, words

from netspark.llm import mixing


def targets_of(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in stopped)
        free = [s for s in names if s not in stopped]
        target = {s: 3.0 * sizes[s] if s in stopped else left * weight[s] / sum(weight[x] for x in free) for s in names}
        above = [s for s in free if target[s] > 3 * sizes[s]]
        if not above:
            return target
        stopped |= set(above)


def test_odd_rows_and_targets(spark):
    out = rows(mixing.taken_words(odd_docs(spark), block=64))
    assert len(out) == len(TEXTS)
    sizes = defaultdict(int)
    for _, t, s in TEXTS:
        sizes[s] += len(words(t))
    want, taken = targets_of(sizes), defaultdict(int)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["copies"] <= 3
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert taken[s] == int(want[s] + 0.5)
    assert rows(mixing.taken_words(empty_docs(spark))) == []


def test_reruns_agree_and_slots_are_spread(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, rows(mixing.taken_words(docs)))) == sorted(map(key, rows(mixing.taken_words(docs.repartition(7)))))
    _, targets, pieces = mixing.mix(docs, block=64)
    share = {r["source"]: r["wanted"] for r in rows(targets)}
    slots = {(r["slot"], r["source"]) for r in rows(pieces)}
    half = sorted({s for s, _ in slots})[len({s for s, _ in slots}) // 2]
    total = sum(share.values())
    for source, wanted in share.items():
        first = sum(1 for s, x in slots if x == source and s < half)
        assert abs(first - half * wanted / total) < 8  # points of low discrepancy: any stretch holds its share


def test_pieces_are_the_stream_in_order(spark):
    docs = odd_docs(spark, [(i, "w " * n, s) for i, n, s in ((1, 5, "a"), (2, 7, "a"), (3, 4, "b"), (4, 1, "b"), (5, 50, "c"))])
    sized, targets, pieces = mixing.mix(docs, block=4)
    size = {(r["source"], r["begin"]): r["size"] for r in rows(sized)}
    seen = defaultdict(list)
    for r in rows(pieces):
        assert 0 <= r["start"] and r["start"] + r["length"] <= size[r["source"], r["begin"]]
        seen[r["source"]].append((r["epoch"], r["begin"] + r["start"], r["length"]))
    for t in rows(targets):
        at = 0
        for epoch, begin, n in sorted(seen[t["source"]]):
            assert epoch * t["source_size"] + begin == at
            at += n
        assert at == t["wanted"]
