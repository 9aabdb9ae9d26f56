"""Whitening against a plain version with the library's eigenvalues, and the parts of the contour method on planted spectra."""

import math
from fractions import Fraction

import numpy as np
import pytest
from fixtures_llm import SF, rows

from netspark.llm import whitening
from netspark.llm.queries import QUERIES


def plain(vectors, components=16):
    """{row number: (deviation, whitened up to signs)} and explained shares, of usable vectors."""
    usable = {i: [math.floor(64 * float(c)) + 1_000_000 for c in v] for i, v in enumerate(vectors)
              if v and all(c is not None and math.isfinite(c) for c in v)}
    lengths = [len(x) for x in usable.values()]
    dims = max(set(lengths), key=lambda d: (lengths.count(d), d))
    usable = {i: x for i, x in usable.items() if len(x) == dims}
    fit = sorted(set(map(tuple, usable.values())))
    n, total = len(fit), [sum(c) for c in zip(*fit)]
    mean = [Fraction(t, n) for t in total]
    centred = np.array([[float(a - m) for a, m in zip(x, mean)] for x in fit])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    keep = values > 1e-9 * values[0]
    out = {}
    for i, x in usable.items():
        away = np.array([float(a - m) for a, m in zip(x, mean)])
        out[i] = sum((n * a - t) ** 2 for a, t in zip(x, total)), (away @ axes / np.sqrt(np.abs(values)))[keep]
    return out, (values / (centred**2).sum() * n)[keep], n


def compared(got, vectors, ids):
    want, explained, n = plain(vectors)
    by_row = {}
    for r in got:
        by_row.setdefault(r["vec_id"], []).append(r)
    assert len(got) == len(want) * len(explained)
    signs = None
    for i, (deviation, whitened) in want.items():
        found = sorted(by_row[ids[i]], key=lambda r: r["component"])
        assert [r["component"] for r in found] == list(range(1, len(explained) + 1))
        assert {(r["n"], int(r["deviation"])) for r in found} == {(n, deviation)}
        assert np.allclose([r["explained"] for r in found], explained, rtol=1e-9)
        assert all(r["identity_error"] <= 1e-8 for r in found)
        mine = np.array([r["whitened"] for r in found])
        assert np.allclose(np.abs(mine), np.abs(whitened), atol=1e-7, rtol=1e-7)
        if signs is None and np.all(np.abs(mine) > 1e-6):
            signs = np.sign(mine * whitened)
        if signs is not None:
            assert np.allclose(mine * signs, whitened, atol=1e-7, rtol=1e-7)


def test_odd_vectors(spark):
    rng = np.random.default_rng(5)
    vectors = [list(map(float, v)) for v in rng.normal(size=(60, 5)) * [3, 2, 1, 1, 0.5]]
    vectors += [vectors[0], vectors[0], None, [], [1.0, None, 2.0, 3.0, 4.0], [1.0, float("nan"), 2.0, 3.0, 4.0], [float("inf")] * 5, [1.0, 2.0], [-1e3] * 5]
    ids = list(range(len(vectors)))
    df = spark.createDataFrame([(i, v, "x", 7) for i, v in zip(ids, vectors)], "vec_id bigint, embedding array<float>, x string, dim int")
    vectors = [None if v is None else [None if c is None else float(np.float32(c)) for c in v] for v in vectors]
    compared(rows(whitening.whiten(df)), vectors, ids)
    # Null keys and a key that repeats are rows like others.
    same = spark.createDataFrame([(None, [1.0, 2.0]), (None, [2.0, 1.0]), (3, [5.0, 5.0]), (3, [5.0, 5.0])], "vec_id bigint, embedding array<double>")
    found = rows(whitening.whiten(same))
    assert sorted((r["vec_id"] is None, r["component"]) for r in found) == [(a, c) for a in (False, True) for c in (1, 1, 2, 2)]


def test_few_vectors_and_empty_tables(spark):
    schema = "vec_id bigint, embedding array<double>"
    assert rows(whitening.whiten(spark.createDataFrame([], schema))) == []
    assert rows(whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema))) == []
    line = rows(whitening.whiten(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [2.0, 2.0])], schema)))
    assert {r["component"] for r in line} == {1} and sorted(round(r["whitened"], 9) for r in line) in ([-1.224744871, 0, 1.224744871],)
    huge = rows(whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0])], schema)))
    assert [r["deviation"] for r in huge][0] > 2**100


def planted(values, seed=1):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    return (q * values) @ q.T, q


SPECTRA = [np.arange(1.0, 65), np.r_[np.full(20, 3.0), np.arange(44) / 100 + 0.1], 2.0 ** -np.arange(40), np.r_[np.zeros(30), 1, 1 + 1e-7, 1 + 2e-7, 2, 2],
           np.r_[np.linspace(1, 1.001, 30), 5], np.full(12, 7.0), np.array([4.0]), np.r_[1e12, np.ones(20), np.full(3, 1e-3)]]


@pytest.mark.parametrize("values", SPECTRA)
def test_contours_on_planted_spectra(values):
    v, _ = planted(values)
    v = (v + v.T) / 2
    form = whitening.tridiagonal(v)
    shifts = np.unique(np.r_[values[:-1] + np.diff(np.sort(values)) / 2, values.max() * 1.1 + 1e-3, -1.0])
    shifts = [s for s in shifts if np.abs(values - s).min() > 1e-9 * values.max()]
    assert whitening.above(form, shifts).tolist() == [int((values > s).sum()) for s in shifts]
    wanted = min(16, int((values > 1e-11 * values.max()).sum()))
    cuts = whitening.intervals(v, 16)
    found = [whitening.feast(v, *cut) for cut in cuts]
    got = np.concatenate([f[0] for f in found])
    axes = np.concatenate([f[1] for f in found], axis=1)
    order = np.argsort(-got)[:wanted]
    want = np.sort(values)[::-1][:wanted]
    assert len(got) >= wanted and np.allclose(got[order], want, rtol=1e-12, atol=1e-13 * values.max())
    assert np.abs(axes.T @ axes - np.eye(len(got))).max() < 1e-6
    residuals = np.linalg.norm(v @ axes - axes * got, axis=0)
    assert residuals.max() < 1e-11 * values.max(), (cuts, residuals)


def test_query_against_the_plain_version(spark):
    table = rows(spark.read.parquet(f"{SF}/embeddings.parquet"))
    compared(rows(QUERIES["op13_feast_whitening"](spark, SF)), [r["embedding"] for r in table], [r["vec_id"] for r in table])
