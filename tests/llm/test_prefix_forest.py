import math
import random

import numpy as np

from galeframe.llm.prefix_forest import nearest

SCHEMA = "vec_id long, embedding array<float>, label int"


def f32(x):
    return [float(np.float32(v)) for v in x]


def plain(rows, k=20, every=20):
    """Every result by comparing all rows; shorter vectors go on with zeros."""
    v = [(i, e) for i, e, *_ in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    out = []
    for n, (q, e) in enumerate(v):
        if q % every == 0:
            scores = []
            for m, (i, x) in enumerate(v):
                if m != n:
                    s = 0.0
                    for a, b in zip(e, x):
                        s += a * b
                    scores.append((-s, i))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def found(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def groups(n, seed, dims=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, dims))
    return [(i, f32(centres[i % 30] + 0.4 * rng.normal(size=dims)), 0) for i in range(n)]


def recall(got, want):
    got, want = ({(q, i) for q, _, i, _ in rows} for rows in (got, want))
    return len(got & want) / len(want)


def test_recall_against_plain_version(spark):
    rows = groups(3000, 1)
    got, want = found(nearest(spark.createDataFrame(rows, SCHEMA), slot_rows=64)), plain(rows)
    assert len(got) == len(want) and recall(got, want) >= 0.9
    scores = {(q, i): s for q, _, i, s in plain(rows, k=3000)}
    assert all(scores[q, i] == s for q, _, i, s in got)  # exactly the measure


def test_few_rows_are_searched_whole(spark):
    rows = groups(60, 2)
    assert found(nearest(spark.createDataFrame(rows, SCHEMA), recall=1.0)) == plain(rows)
    assert found(nearest(spark.createDataFrame(rows[:7], SCHEMA), recall=1.0)) == plain(rows[:7])


def test_copies_tie_by_id_and_large_slots_are_dealt_out(spark):
    random.seed(3)
    rows = groups(200, 3) + [(1000 + i, [0.5] * 16, 0) for i in range(400)]
    random.shuffle(rows)
    got = found(nearest(spark.createDataFrame(rows, SCHEMA), recall=1.0, slot_rows=50, visit_rows=5))
    assert got == plain(rows)


def test_odd_rows(spark):
    rows = [(20, [1.0, 2.0], None), (1, [1.0, -1.0], 1), (2, None, 1), (3, [None, 1.0], 1), (4, [float("nan"), 1.0], 1), (5, [float("inf"), 0.0], 1), (6, [1.0], 1), (7, [], 1),
            (None, [9.0, 9.0], 1), (40, [0.0, 0.0], 1), (8, [1.0, -1.0], 1), (8, [1.0, -1.0], 1), (60, [3.0, 0.0], 1), (60, [3.0, 0.0], 1), (60, [1.0, 1.0], 1), (9, [3.0], 1), (-20, [-1.0, -0.0, 2.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(nearest(df, recall=1.0)) == plain(rows)
    wide = df.selectExpr("*", "'x' AS score", "1 AS rid", "2 AS h", "3 AS v", "4 AS rank")
    assert found(nearest(wide, recall=1.0)) == plain(rows)
    assert nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert nearest(spark.createDataFrame([(20, [1.0], 0)], SCHEMA)).count() == 0
    assert nearest(spark.createDataFrame([(1, [1.0], 0), (2, [1.0], 0)], SCHEMA)).count() == 0  # no query
