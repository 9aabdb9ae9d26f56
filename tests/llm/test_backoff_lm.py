import math
import zlib
from collections import Counter

import numpy as np
import pytest
from fixtures_llm import SF, TEXTS, empty_docs, odd_docs, rows, table, words
from hypothesis import given
from hypothesis import strategies as st

from netspark.llm import backoff_lm as L
from netspark.llm.queries import QUERIES


def expected(texts, order):
    docs = [(i, words(t, lower=True) + ["</s>"], i is None or zlib.crc32(str(i).encode()) % 10 == 0) for i, t in texts]
    counts = [Counter() for _ in range(order + 1)]
    starts = 0
    for _, w, held in docs:
        if not held:
            starts += 1
            seq = ["<s>"] + w
            for k in range(1, order + 1):
                for j in range(len(w)):
                    gram = tuple(seq[max(0, j + 2 - k): j + 2])
                    if len(gram) == k and not (k == 1 and gram[0] == "<s>"):
                        counts[k][gram] += 1
    total, distinct = sum(counts[1].values()), len(counts[1])

    def chance(gram):
        if len(gram) == 1:
            return (counts[1][gram] + L.ADD) / (total + L.ADD * (distinct + 1))
        context = starts if gram[:-1] == ("<s>",) else counts[len(gram) - 1][gram[:-1]]
        lower = chance(gram[1:])
        return (counts[len(gram)][gram] + L.BACKOFF * lower) / (context + L.BACKOFF)

    out = []
    for i, w, held in docs:
        seq = ["<s>"] + w
        base = sum(math.log10(chance((x,))) for x in w)
        score = sum(math.log10(chance(tuple(seq[max(0, j + 2 - order): j + 2]))) for j in range(len(w)))
        out.append((i, held, len(w), sum(counts[1][(x,)] > 0 for x in w), total, base, score))
    return out


def check(out, want):
    cols = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    key = lambda r: (str(r[0]), r[2], round(r[5], 4))
    got = sorted((tuple(r[c] for c in cols) for r in out), key=key)
    for g, w in zip(got, sorted(want, key=key), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_query(spark):
    out = rows(QUERIES["op6_backoff_scores"](spark, SF))
    check(out, expected([(d["doc_id"], d["text"]) for d in table("documents")], L.ORDER))
    held = [r for r in out if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_orders_and_odd_rows(spark, order, monkeypatch):
    monkeypatch.setattr(L, "BUCKET_KEYS", 20_000)
    check(rows(L.score(odd_docs(spark), order=order)), expected([(i, t) for i, t, _ in TEXTS], order))


def test_many_blocks(spark):
    docs = odd_docs(spark, [(i, f"a b c w{i % 7} d e w{i % 5}", "s") for i in range(300)]).repartition(9)
    check(rows(L.score(docs)), expected([(i, f"a b c w{i % 7} d e w{i % 5}") for i in range(300)], L.ORDER))


def test_empty_and_untrained(spark):
    assert rows(L.score(empty_docs(spark))) == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    check(rows(L.score(odd_docs(spark, [(held, "x y", "s")]))), expected([(held, "x y")], L.ORDER))


@given(st.lists(st.integers(0, 2**32 - 1)))
def test_numbers_round_trip(numbers):
    x = np.array(numbers, np.uint32)
    assert L.unpack_numbers(L.pack_numbers(x)).tolist() == numbers


@given(st.lists(st.integers(0, 2**64 - 1)))
def test_keys_round_trip(numbers):
    assert L.unpack_keys(L.pack_keys(np.sort(np.array(numbers, np.uint64)))).tolist() == sorted(numbers)


def test_registered_order_counts_trigrams(spark):
    """After "a b" comes c, after "x b" comes d: only a third token of context tells them apart."""
    docs = [(i, "a b c" if i % 2 else "x b d", "s") for i in range(200)] + [(1000, "a b d", "s")]
    out = {r["doc_id"]: r["score"] for r in rows(L.score(odd_docs(spark, docs)))}
    assert out[1] - out[1000] > 0.5


@given(st.lists(st.integers(0, 2**64 - 1)))
def test_large_numbers_round_trip(numbers):
    assert L.unpack_numbers(L.pack_numbers(np.array(numbers, np.uint64))).tolist() == numbers


def test_sums_pass_32_bits():
    """Two requests for one word whose counts add up to more than 32 bits."""
    import pyarrow as pa

    keys, counts = L.pack_keys(np.array([7], np.uint64)), L.pack_numbers(np.array([2**32 - 5]))
    asked = pa.table({"bucket": pa.array([0, 0], pa.int32()), "block": pa.array([1, 2], pa.int64()), "level": pa.array([1, 1], pa.int32()),
                      "keys": pa.array([keys] * 2, pa.binary()), "counts": pa.array([counts] * 2, pa.binary())})
    assert [L.unpack_numbers(x).tolist() for x in L.answer(asked).column("sums").to_pylist()] == [[2**33 - 10]] * 2
