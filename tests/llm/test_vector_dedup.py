from collections import defaultdict

import numpy as np
import pytest
from fixtures_llm import rows

from netspark.llm import vector_dedup as V

SCHEMA = "vec_id bigint, embedding array<float>, label int, size string, rep string, leaf int"


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], tag, "s", "r", 1) for i, v, tag in vectors], SCHEMA)


def expected(vectors):
    use = []
    for i, v, tag in vectors:
        x = None if v is None or tag is None or i is None or not len(v) or any(c is None for c in v) else np.array(v, np.float32).astype(float)
        use.append(x if x is not None and np.isfinite(x).all() and x.any() else None)
    parent = {i: i for i, _, _ in vectors if i is not None}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    links = [0] * len(vectors)
    for a in range(len(vectors)):
        for b in range(a):
            if use[a] is None or use[b] is None or vectors[a][2] != vectors[b][2] or len(use[a]) != len(use[b]):
                continue
            if use[a] @ use[b] / np.sqrt((use[a] @ use[a]) * (use[b] @ use[b])) >= 0.98:
                links[a] += 1
                links[b] += 1
                low, high = sorted((find(vectors[a][0]), find(vectors[b][0])))
                parent[high] = low
    return links, {i: find(i) for i in parent}


def check(out, vectors):
    links, part = expected(vectors)
    assert sorted(str((r["vec_id"], r["n_links"])) for r in out) == sorted(str((v[0], n)) for v, n in zip(vectors, links))
    for r in out:
        assert r["component_id"] == part.get(r["vec_id"])
        assert r["kept"] == (r["vec_id"] is None or r["component_id"] == r["vec_id"])


def some_vectors(seed=0, n=1500, dim=64):
    rng = np.random.default_rng(seed)
    out = [(i, rng.standard_normal(dim), i % 3) for i in range(n)]
    centre = rng.standard_normal(dim)
    out += [(n + i, centre + 0.11 * rng.standard_normal(dim), 1) for i in range(300)]  # a dense group around the bound
    out += [(2 * n + i, out[i][1] + 0.1 * rng.standard_normal(dim), out[i][2]) for i in range(200)]
    out += [(3 * n + i, out[7][1], out[7][2]) for i in range(50)]  # exact copies
    return out


def test_forest_finds_all_links(spark):
    vectors = some_vectors()
    check(rows(V.near_vectors(frame(spark, vectors))), vectors)


def test_large_leaves_go_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_ROWS", 40)
    vectors = some_vectors(4, 400)
    check(rows(V.near_vectors(frame(spark, vectors), trees=3)), vectors)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(1, None, 1), (2, [], 1), (3, [0, 0], 1), (4, [nan, 1], 1), (5, [inf, 1], 1), (6, [1, None], 1), (7, [1, 1], None), (8, [1, 1], 1), (9, [2, 2], 1),
               (10, [1, 1], 2), (11, [1, 1, 1], 1), (12, [1, 1], 1), (12, [1, 1], 1), (13, [-1, -1], 1), (None, [1, 1], 1), (14, [1, 0.0], 1), (15, [0.0, 1], 1), (15, [1, 0.01], 1)]
    check(rows(V.near_vectors(frame(spark, vectors))), vectors)
    assert rows(V.near_vectors(frame(spark, []))) == []


def test_recall_on_the_given_table(spark):
    import pyarrow.parquet as pq
    read = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pylist()
    by = defaultdict(list)
    for r in read:
        by[r["label"]].append(r)
    want = 0
    for group in by.values():
        x = np.array([r["embedding"] for r in group], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        want += int((np.triu(x @ x.T, 1) >= 0.98).sum())
    got = sum(r["n_links"] for r in rows(V.near_vectors(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")))) / 2
    assert got <= want + 1e-9 and got >= 0.99 * want


def test_spill_covers_most_pairs():
    assert V.spill_width(64) == pytest.approx(0.0125)
