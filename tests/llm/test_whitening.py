import math

import numpy as np
import pytest

from galeframe.llm.whitening import Spectrum, rank_one, whiten

SCHEMA = "vec_id long, embedding array<float>, label int"


def f32(x):
    return [float(np.float32(v)) for v in x]


def plain(rows, components=32):
    """n, exact deviations, eigenvalues and whitened rows (up to signs) from the whole covariance."""
    kept = [(i, e) for i, e, *_ in rows if e is not None and all(c is not None and math.isfinite(c) for c in e)]
    dims, n = max(len(e) for _, e in kept), len(kept)
    x = [[math.floor(64 * c) + 1_000_000 for c in e] + [1_000_000] * (dims - len(e)) for _, e in kept]
    sums = [sum(col) for col in zip(*x)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in x]
    mean = [s // n for s in sums]
    y = np.array([[float(c - m) - (s % n) / n for c, m, s in zip(r, mean, sums)] for r in x])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    return [i for i, _ in kept], n, deviation, values[::-1], y, vectors[:, ::-1]


def check(df, rows, components=32):
    ids, n, deviation, values, y, vectors = plain(rows)
    k = min(components, len(values))
    got = df.collect()
    assert len(got) == k * len(ids) and {r["n"] for r in got} == {n}
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["deviation"]) for r in got if r["component"] == 1) == sorted((i is None, i or 0, d) for i, d in zip(ids, deviation))
    assert max(r["identity_error"] for r in got) <= 1e-9
    by = {}
    for r in got:
        by.setdefault(r["component"], []).append(r)
    for c, part in by.items():
        assert part[0]["explained"] == pytest.approx(values[c - 1] / values.sum(), rel=1e-9, abs=1e-12)
        if values[c - 1] <= 1e-12 * values[0]:
            assert all(r["whitened"] is None for r in part)
            continue
        want = sorted(zip(deviation, y @ vectors[:, c - 1] / np.sqrt(values[c - 1])))
        have = sorted((r["deviation"], r["whitened"]) for r in part)
        sign = 1 if abs(sum(a * b for (_, a), (_, b) in zip(want, have))) == sum(a * b for (_, a), (_, b) in zip(want, have)) else -1
        assert max(abs(a - sign * b) for (_, a), (_, b) in zip(want, have)) < 1e-6


def test_rank_one_updates():
    rng = np.random.default_rng(0)
    for case in range(200):
        n = int(rng.integers(1, 50))
        d = np.sort(np.abs(rng.normal(size=n)) * 10.0 ** rng.integers(-3, 6))
        u, v = np.linalg.qr(rng.normal(size=(n, n)))[0], rng.normal(size=n) * 10.0 ** rng.integers(-3, 3)
        match case % 5:
            case 1:
                d = np.zeros(n)
            case 2:
                d = np.sort(np.round(d / d.max() * 3))  # equal eigenvalues
            case 3:
                v = u[:, rng.integers(n)] * 3.0  # all directions but one deflated
            case 4:
                d = np.sort(np.concatenate([d[:n // 2], d[:n - n // 2] * (1 + 1e-15)]))
        want = (u * d) @ u.T + 2.0 * np.outer(v, v)
        new, turned = rank_one(d.copy(), u.copy(), 2.0, v)
        size = max(d.max(), 2 * v @ v)
        assert np.abs((turned * new) @ turned.T - want).max() <= 1e-12 * size
        assert np.abs(turned.T @ turned - np.eye(n)).max() <= 1e-12
        assert (np.diff(new) >= 0).all()


def test_spectra_combine():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 12)) * np.arange(1, 13) + 5.0
    whole, parts = Spectrum.empty(12), [Spectrum.empty(12) for _ in range(3)]
    whole.add(x)
    for s, part in zip(parts, (x[:3], x[3:200], x[200:])):
        s.add(part)
    for s in parts[1:]:
        parts[0].merge(s)
    parts[0].merge(Spectrum.empty(12))
    want = np.linalg.eigvalsh(np.cov(x.T, bias=True) * 500)
    for s in (whole, parts[0]):
        assert s.n == 500 and np.allclose(s.mean, x.mean(0)) and np.allclose(s.d, want, rtol=1e-10)


def test_against_plain_version(spark):
    rng = np.random.default_rng(2)
    mix = rng.normal(size=(40, 40)) * np.geomspace(3, 0.05, 40)
    rows = [(i, f32(r), 0) for i, r in enumerate(rng.normal(size=(900, 40)) @ mix)]
    rows += [(5000 + i, rows[0][1], 0) for i in range(300)]  # a group of copies
    df = spark.createDataFrame(rows, SCHEMA).repartition(23)
    check(whiten(df), rows)


def test_odd_rows(spark):
    rows = [(1, [1.0, -1.0, 0.5], 1), (2, None, 1), (3, [None, 1.0, 1.0], 1), (4, [float("nan"), 1.0, 0.0], 1), (5, [float("inf"), 0.0, 1.0], 1), (6, [1.0], 1), (7, [], 1),
            (None, [9.0, 9.0, 9.0], 1), (8, [2.0, 5.0, -3.0], None), (8, [2.0, 5.0, -3.0], None)]
    df = spark.createDataFrame(rows, SCHEMA)
    check(whiten(df), rows)
    check(whiten(df.selectExpr("*", "1 AS v", "2 AS n", "3 AS component", "4 AS _part")), rows)
    assert whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whiten(spark.createDataFrame([(1, None, 0), (2, [], 0)], SCHEMA)).count() == 0
    same = whiten(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], SCHEMA)).collect()
    assert len(same) == 4 and all(r["whitened"] is None and r["deviation"] == 0 and r["explained"] == 0.0 and r["identity_error"] == 0.0 for r in same)


def test_large_components(spark):
    rows = [(i, f32([3e9 * i, (-1) ** i * 1e12]), 0) for i in range(6)]
    _, n, deviation, *_ = plain(rows)
    got = {r["vec_id"]: r["deviation"] for r in whiten(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: d if d < 2**63 else None for i, d in enumerate(deviation)}
    rows = [(i, f32([3e6 * i, 1.0]), 0) for i in range(6)]
    _, n, deviation, *_ = plain(rows)
    assert {r["vec_id"]: r["deviation"] for r in whiten(spark.createDataFrame(rows, SCHEMA)).collect()} == dict(enumerate(deviation))
