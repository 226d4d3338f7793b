import math
import random

import numpy as np

from galeframe.llm.mtree import top_k

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k=10, every=100, dim=None):
    v = []
    for i, e, *_ in rows:
        if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e) and (dim is None or len(e) == dim):
            v.append((i, [math.floor(1024 * float(x)) for x in e]))
    out = set()
    for q, e in {(i, tuple(e)) for i, e in v if i % every == 0}:
        best = sorted((-min(2**63 - 1, sum(a * b for a, b in zip(e, x))), i) for i, x in v if i != q)[:k]  # scores end at 64 bits
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


def found(df):
    rows = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def f32(x):
    return [float(np.float32(v)) for v in x]


def test_against_plain_version(spark):
    rnd = random.Random(1)
    rows = [(i, f32(rnd.gauss(0, 1) for _ in range(8)), 0) for i in range(-100, 700)]
    rows += [(1000 + i, f32([0.5] * 8), 0) for i in range(300)]  # copies of one vector: ties
    rows += [(2000 + i, f32([rnd.gauss(3, 0.1)] + [0.0] * 7), 0) for i in range(100)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows)
    for settings in ({}, {"page_rows": 16, "pivots": 20, "slot_pages": 3, "block_rows": 4}):
        assert found(top_k(df, **settings)) == want


def test_odd_rows(spark):
    rows = [(100, [1.0, 2.0], None), (1, [1.0, -1.0], 1), (2, None, 1), (3, [None, 1.0], 1), (4, [float("nan"), 1.0], 1), (5, [float("inf"), 0.0], 1), (6, [1.0], 1), (7, [], 1),
            (None, [9.0, 9.0], 1), (200, [0.0, 0.0], 1), (200, [0.0, 0.0], 1), (8, [1.0, -1.0], 1), (8, [1.0, -1.0], 1)]
    got = [tuple(r) for r in top_k(spark.createDataFrame(rows, SCHEMA)).collect()]
    v = [(i, [math.floor(1024 * x) for x in e]) for i, e, _ in rows if i in (100, 1, 200, 8) and e]
    want = []
    for q, e in ((100, v[0][1]), (200, [0, 0])):
        best = sorted((-sum(a * b for a, b in zip(e, x)), i) for i, x in v if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(got) == sorted(want)
    assert top_k(spark.createDataFrame([], SCHEMA)).count() == 0
    assert top_k(spark.createDataFrame([(1, [1.0], 0)], SCHEMA)).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(100, [3e9, 1.0], 0), (1, [2e6, 1.0], 0), (2, [2e6, 2.0], 0), (3, [1.5, 1e9], 0)]
    rows = [(i, f32(e), c) for i, e, c in rows]
    assert found(top_k(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
