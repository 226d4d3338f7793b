import random
import zlib

import numpy as np

from galeframe.llm import quality_gbt as m


def documents(rnd, n):
    good, bad = "the of and river stone valley morning little window".split(), "BUY!! CHEAP!! NOW!! $$$ ###".split()
    rows, labels = [], []
    for i in range(n):
        ok = rnd.random() < 0.7
        rows.append((i, " ".join(rnd.choice(good if ok else bad) for _ in range(rnd.randint(5, 80)))))
        labels.append((i, int(ok), 0))
    return rows, labels


def test_trees_against_a_plain_walk():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(600, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    forest = m.grow(x, y, trees=40, depth=3)
    score = forest.score(x)
    assert ((score > 0.5) == (y > 0)).mean() > 0.97
    b = forest.bins(x)
    for i in range(0, 600, 37):
        margin = forest.base
        for t in range(len(forest.feature)):
            node = 0
            while node < forest.feature.shape[1]:
                node = 2 * node + (2 if b[i, forest.feature[t, node]] > forest.cut[t, node] else 1)
            margin += forest.leaf[t, node - forest.feature.shape[1]]
        assert abs(score[i] - 1 / (1 + np.exp(-margin))) < 1e-12


def test_one_class_and_no_rows():
    assert np.allclose(m.grow(np.zeros((5, 2)), np.ones(5)).score(np.zeros((3, 2))), 0.999)
    assert np.allclose(m.grow(np.zeros((0, 2)), np.zeros(0)).score(np.zeros((3, 2))), 0.5)


def test_held_out_accuracy_and_leaks(spark):
    rows, labels = documents(random.Random(1), 600)
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in m.score_quality(docs, marks).select("*", m.held_out("doc_id").alias("held_out")).collect()}
    truth = {i: q for i, q, _ in labels}
    held = [i for i in truth if out[i]["held_out"]]
    assert {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2} == set(held)
    assert sum(out[i]["predicted"] == truth[i] for i in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out.values())
    flipped = spark.createDataFrame([(i, 1 - q if i in set(held) else q, 0) for i, q, _ in labels], marks.schema)
    again = {r["doc_id"]: r["score"] for r in m.score_quality(docs, flipped).collect()}
    assert all(again[i] == out[i]["score"] for i in again)  # held-out labels are never read


def test_odd_rows(spark, odd, empty):
    marks = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (6, 1, 0), (8, None, 0), (None, 1, 1), (77, 0, 0)], "doc_id long, quality int, toxic int")
    wide = odd.selectExpr("*", "'x' AS score", "1 AS x")
    out = m.score_quality(wide, marks)
    assert out.count() == odd.count() and set(out.columns) == {*wide.columns, "predicted"}
    assert all(0 <= r["score"] <= 1 for r in out.collect())
    assert m.score_quality(empty, marks).count() == 0
    assert {r["score"] for r in m.score_quality(odd, marks.filter("false")).collect()} == {0.5}
    assert m.statistics(None) == m.statistics(" \n") == [0.0] * len(m.STATISTICS)
