import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from fixtures_llm import LONG, PROSE, SF, TEXTS, empty_docs, odd_docs, rows, table, words

from netspark.llm import hashing, minhash
from netspark.llm.queries import QUERIES


def shingle_set(text):
    w = words(text, lower=True)
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def expected(texts):
    sets, parent, where = defaultdict(list), {}, defaultdict(set)
    for i, t in texts:
        if i is not None:
            parent[i] = i
            sets[i].append(shingle_set(t))
            for s in sets[i][-1]:
                where[s].add((i, len(sets[i]) - 1))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, own in sets.items():
        for s in own:
            for j, k in {m for x in s for m in where[x]}:
                other = sets[j][k]
                both = len(s & other)
                if 100 * both >= 75 * len(s | other) and find(i) != find(j):
                    a, b = sorted((find(i), find(j)))
                    parent[b] = a
    return {i: find(i) for i in parent}


def check(out, texts):
    want = expected(texts)
    assert sorted(str((r["doc_id"], r["n_shingles"])) for r in out) == sorted(str((i, len(shingle_set(t)))) for i, t in texts)
    for r in out:
        assert r["component_id"] == want.get(r["doc_id"])
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"])


def test_query(spark):
    check(rows(QUERIES["op5_minhash_near_duplicates"](spark, SF)), [(d["doc_id"], d["text"]) for d in table("documents")])


def test_odd_rows(spark):
    check(rows(minhash.near_duplicates(odd_docs(spark))), [(i, t) for i, t, _ in TEXTS])
    assert rows(minhash.near_duplicates(empty_docs(spark))) == []


def test_groups_of_copies_chains_and_near_misses(spark):
    rng = random.Random(3)
    base = [f"v{rng.randrange(10**6)}" for _ in range(120)]
    texts = [(i, " ".join(base)) for i in range(100, 160)]  # exact copies
    for i in range(60):  # near copies, each with a few words changed
        w = list(base)
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        texts.append((i, " ".join(w)))
    chain = [f"c{rng.randrange(10**6)}" for _ in range(200)]
    for i in range(30):  # a chain: each is near the next, the ends share nothing
        texts.append((1000 - i, " ".join(chain[i * 3: i * 3 + 80])))
    # One id with two texts joins their groups.
    texts += [(500, PROSE * 3), (501, LONG[:900]), (502, PROSE * 3), (502, LONG[:900])]
    check(rows(minhash.near_duplicates(odd_docs(spark, [(i, t, "s") for i, t in texts]).select("doc_id", "text"))), texts)


def test_hashes_do_not_depend_on_slabs(monkeypatch):
    texts = pa.array([LONG, PROSE, None, "", " x ", "É\x85 \x0b ß", LONG[:50_000] + "y" * 9000])
    whole = [w.tolist() for w in hashing.text_words(texts)]
    monkeypatch.setattr(hashing, "SLAB", 4096)
    assert [w.tolist() for w in hashing.text_words(texts)] == whole
    assert [len(w) for w in whole] == [len(words(t.as_py())) for t in texts]
    assert whole[5][0] == hashing.word_hashes(np.frombuffer("É\x85".encode(), np.uint8))[0]
    distinct = {w for t in texts for w in words(t.as_py(), lower=True)}
    assert len({h for w in whole for h in w}) == len(distinct)


def test_bounds_lose_no_true_pair():
    rng, bounds = np.random.default_rng(1), minhash.least_matches()
    assert list(bounds) == sorted(bounds) and bounds[-1] > 100
    matches = rng.random((200_000, minhash.COMPARED)) < 0.75
    looks = matches.reshape(len(matches), -1, minhash.BATCH).sum(axis=2).cumsum(axis=1)
    assert (looks < np.array(bounds)).any(axis=1).mean() < 1e-4
    low = rng.random((20_000, minhash.COMPARED)) < 0.4
    looks = low.reshape(len(low), -1, minhash.BATCH).sum(axis=2).cumsum(axis=1)
    assert (looks < np.array(bounds)).any(axis=1).mean() > 0.999


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    b = np.concatenate([a[:2400], rng.integers(0, 1 << 63, 600, dtype=np.uint64)])
    same = (minhash.signature(a) == minhash.signature(b)).mean()
    assert abs(same - 2400 / 3600) < 0.08


def test_words_of_two_letters_in_thue_morse_order_do_not_collide(spark):
    """A polynomial modulo 2 ** 64 takes such words for equal."""
    order = [bin(i).count("1") & 1 for i in range(4096)]
    hashed = lambda w: int(hashing.word_hashes(np.frombuffer(w.encode(), np.uint8))[0])
    for n in (64, 1024, 2048, 4096):
        x, y = "".join("ab"[b] for b in order[:n]), "".join("ba"[b] for b in order[:n])
        assert hashed(x) != hashed(y)
    swapped = [hashed(w) for w in ("aaaaaaaabbbbbbbb", "bbbbbbbbaaaaaaaa", "aaaaaaaa", "aaaaaaaa\0", "\0aaaaaaaa")]
    assert len(set(swapped)) == len(swapped)
    x, y = "".join("ab"[b] for b in order[:1024]), "".join("ba"[b] for b in order[:1024])
    docs = spark.createDataFrame([(1, f"{x} one two three four"), (2, f"{y} one two three four")], "doc_id bigint, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in rows(minhash.near_duplicates(docs))) == [(1, 1), (2, 2)]


def test_word_hashes_equal_those_of_single_words():
    rng = random.Random(8)
    text = ["".join(rng.choice("aAbBzZ09é") for _ in range(rng.choice([1, 7, 8, 9, 40]))) for _ in range(500)]
    got = hashing.word_hashes(np.frombuffer(" \t".join(text).encode(), np.uint8))
    one = [int(hashing.word_hashes(np.frombuffer(w.encode(), np.uint8))[0]) for w in text]
    assert got.tolist() == one
    low = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in text]
    assert len(set(one)) == len(set(low))
