import random
import zlib
from itertools import combinations

from galeframe.llm import sharding as m


def test_minimax_against_all_partitions():
    rnd = random.Random(1)
    for _ in range(150):
        sizes, k = [rnd.randint(1, 30) for _ in range(rnd.randint(1, 9))], rnd.randint(1, 4)
        want = min(max(sum(sizes[a:b]) for a, b in zip((0, *c), (*c, len(sizes)))) for n in range(min(k, len(sizes))) for c in combinations(range(1, len(sizes)), n))
        cuts = m.minimax_cuts(sizes, k)
        assert len(cuts) <= k and max(sum(sizes[a:b]) for a, b in zip(cuts, [*cuts[1:], len(sizes)])) == want


def check(docs, shards):
    rows = m.shard_documents(docs, shards=shards, slice_rows=50).collect()
    source = docs.collect()
    assert len(rows) == len(source)
    want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in source)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == want
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    home = {}
    for r in rows:
        assert home.setdefault((r["size"], r["text_crc32"]), r["shard"]) == r["shard"]  # equal texts stay together
    load = {}
    for r in rows:
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
    return load


def test_even_shards(spark):
    rnd = random.Random(2)
    docs = spark.createDataFrame([(i, "é" * rnd.randint(0, 300)) for i in range(3000)], "doc_id long, text string")
    load = check(docs, 8)
    assert len(load) == 8 and max(load.values()) <= 1.1 * sum(load.values()) / 8


def test_large_group_of_copies_leaves_the_others_even(spark):
    docs = spark.createDataFrame([(i, "the same text for a third of all rows" if i % 3 == 0 else f"another text {i:08d} of about this size") for i in range(3000)], "doc_id long, text string")
    load = sorted(check(docs, 10).values())
    assert len(load) == 10 and load[-1] > 2.5 * load[-2] and load[0] >= 0.85 * load[-2]


def test_odd_rows(odd, empty):
    check(odd, 3)
    check(odd, 40)
    assert m.shard_documents(empty).count() == 0
    assert m.shard_documents(odd.selectExpr("*", "1 AS cell", "2 AS shard", "3 AS slice")).count() == odd.count()
