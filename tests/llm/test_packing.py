import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from fixtures_llm import LONG, SF, TEXTS, empty_docs, odd_docs, rows, table
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from netspark.llm import packing
from netspark.llm.queries import QUERIES

WHOLE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return np.array(WHOLE.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


def check(out, texts, capacity=2048):
    by, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    want = defaultdict(list)
    for i, text in texts:
        ids = ids_of(text)
        first = len(ids) % capacity if len(ids) > capacity else len(ids)
        at, p = 0, 0
        for size in [first] * (first > 0) + [capacity] * ((len(ids) - first) // capacity):
            want[i].append((p, at, size, zlib.crc32(ids[at:at + size].tobytes())))
            at, p = at + size, p + 1
        assert at == len(ids)
    for i in want:
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by[i]) == sorted(want[i])
    assert set(by) == set(want)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(sequences), -(-sum(r["length"] for r in out) // capacity)


def test_query(spark):
    used, least = check(rows(QUERIES["op4_best_fit_packing"](spark, SF)), [(d["doc_id"], d["text"]) for d in table("documents")])
    assert used <= least * 1.03 + 1


def test_odd_rows(spark):
    assert len(ids_of(LONG)) > 2048 * 20
    check(rows(packing.pack_documents(odd_docs(spark))), [(i, t) for i, t, _ in TEXTS])
    assert rows(packing.pack_documents(empty_docs(spark))) == []


def test_two_libraries_agree():
    encode = packing.encoder("byte_bpe_50k")
    texts = ["", " ", "  \n\n\t x", "a" * 5000, "日本語 emoji 👩‍👩‍👧 ñ é   \x85 x", "don't I'LL 12345 ___ ...", "<|endoftext|> in text", " " * 3000 + "x", "\r\n\r\n a"]
    for t in texts + [d["text"] for d in table("documents")]:
        assert encode(t).tolist() == WHOLE.encode(t, add_special_tokens=False).ids


def test_many_equal_lengths_use_salts(spark, monkeypatch):
    monkeypatch.setattr(packing, "salts_for", lambda n: 3)
    cut = spark.range(500).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "IF(id % 3 = 0, 700L, 300L + id % 5) AS length", "id AS ids_crc32")
    out = rows(packing.pack(cut, 1000))
    by = defaultdict(int)
    for r in out:
        by[r["sequence_id"]] += r["length"]
    assert len(out) == 500 and max(by.values()) <= 1000 and len({(r["sequence_id"], r["offset"]) for r in out}) == 500


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_sweeps_place_everything_tightly(lengths):
    capacity = 64
    todo, gaps, sequences, rounds = np.bincount(np.array(lengths, int), minlength=capacity + 1), np.zeros(capacity + 1, int), 0, 0
    while todo.any():
        fits, opens = packing.sweep(todo, gaps, capacity)
        rounds += 1
        assert fits or opens
        for size, _, used, length, _, each, took in fits:
            gaps[size] -= used
            rest = took - (used - 1) * each
            gaps[size - each * length] += used - 1
            gaps[size - rest * length] += 1
            todo[length] -= took
        for length, _, n, each, new in opens:
            sequences += new
            rest = n - (new - 1) * each
            gaps[capacity - each * length] += new - 1
            gaps[capacity - rest * length] += 1
            todo[length] -= n
        gaps[0] = 0
        assert (gaps >= 0).all() and (todo >= 0).all()
    # Never worse than first-fit's known bound.
    assert sequences <= 1.7 * sum(lengths) / capacity + 1 and rounds <= 60


def test_few_documents_open_no_sequence_that_gaps_make_needless():
    todo, gaps = np.bincount([1, 2], minlength=65), np.bincount([61], minlength=65)
    assert packing.sweep(todo, gaps, 64)[1] == []
    assert [o[0] for o in packing.sweep(todo, gaps, 64, spare=1)[1]] == [1]
