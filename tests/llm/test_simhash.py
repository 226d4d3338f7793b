import random
import re

import numpy as np
import xxhash

from galeframe.llm import simhash
from galeframe.llm.components import connected

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_print(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in ([" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    """{id: smallest id reachable} for (id, fingerprint) pairs."""
    root = list(range(len(prints)))
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, f"{f:016x}", least.get(find(i))) for i, (d, f) in enumerate(prints)), key=str)


def texts():
    rnd = random.Random(9)
    vocab = [f"w{i}" for i in range(300)]
    base = [" ".join(rnd.choice(vocab) for _ in range(120)) for _ in range(25)]
    out = []
    for i, b in enumerate(base):
        out.append(b)
        for _ in range(i % 5):
            w = b.split()
            w[rnd.randrange(len(w))] = "changed"
            out.append(" ".join(w))
    return [(i * 3, t) for i, t in enumerate(out)] + [(1000, "a"), (1001, "A"), (1002, "a b"), (1003, "")]


def found(df):
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect()), key=str)


def test_against_plain_version(spark):
    rows = texts()
    got = found(simhash.simhash_classes(spark.createDataFrame(rows, "doc_id long, text string")))
    want = plain_components([(d, plain_print(t)) for d, t in rows])
    assert got == want and len({r[2] for r in got}) < len(got)


def test_odd_rows(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert found(simhash.simhash_classes(odd)) == plain_components([(d, plain_print(t)) for d, t in rows])
    assert simhash.simhash_classes(empty).count() == 0
    kept = [r["doc_id"] for r in simhash.one_per_component(odd).collect()]
    assert sorted(kept, key=str) == sorted({1, 3, 5, 6, 8, None}, key=str)
    assert simhash.one_per_component(odd).columns == odd.columns


def test_one_row_of_each_component_where_ids_repeat(spark):
    """Repeated ids with other texts, and copies without an id."""
    a, b, c, d = ("alpha beta gamma delta", "one two three four five", "red green blue white black", "north south east west")
    rows = [(3, a), (5, a), (5, b), (5, b), (9, b), (None, c), (None, c), (7, d), (None, d), (None, None), (None, "")]
    kept = simhash.one_per_component(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["text"] or None) for r in kept), key=str) == sorted([(3, a), (5, b), (None, c), (7, d), (None, None)], key=str)


def clusters(rnd, centres, size):
    out = set()
    for _ in range(centres):
        c = rnd.getrandbits(64)
        for _ in range(size):
            f = c
            for b in rnd.sample(range(64), rnd.randint(0, 4)):
                f ^= 1 << b
            out.add(f)
    return sorted(out)


def test_links_hold_every_component(spark, monkeypatch):
    """Short runs, long runs and very long runs give the components of the full comparison."""
    f = clusters(random.Random(3), 6, 60)
    signed = [x - (1 << 64) if x >> 63 else x for x in f]
    want = {}
    for d, _, c in plain_components(list(enumerate(f))):
        want.setdefault(c, set()).add(d)
    for short, large in ((32, 4096), (2, 4096), (2, 8)):
        key = np.array(sorted(((i << 32 | ((x >> 32 * (i // 32)) & 0xFFFFFFFF & ~(1 << i % 32))), x) for x in f for i in range(64)), dtype=object)
        k, v = np.array([x[0] for x in key], np.int64), np.array([x[1] for x in key], np.uint64)
        monkeypatch.setattr(simhash, "SHORT_RUN", short)
        monkeypatch.setattr(simhash, "LARGE_RUN", large)
        place = {x: i for i, x in enumerate(f)}
        root = list(range(len(f)))
        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        n = 0
        for a, b in simhash._run_links(k, v):
            n += len(a)
            for x, y in zip(a.tolist(), b.tolist()):
                assert (x ^ y).bit_count() <= 3
                i, j = sorted((find(place[x]), find(place[y])))
                root[j] = i
        got = {}
        for i in range(len(f)):
            got.setdefault(find(i), set()).add(i)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert len(signed) == len(f)


def test_variants_share_a_key_up_to_three_bits(spark):
    rnd = random.Random(8)
    pairs = []
    for _ in range(50):
        a = rnd.getrandbits(64)
        b = a
        for bit in rnd.sample(range(64), 3):
            b ^= 1 << bit
        pairs += [a, b]
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in pairs], "fp long")
    keys = {}
    for r in simhash.variants(df).collect():
        keys.setdefault(r["fp"] % (1 << 64), set()).add(r["key"])
    assert all(len(keys[a]) == 64 and keys[a] & keys[b] for a, b in zip(pairs[::2], pairs[1::2]))


def test_long_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (5, 5)], "u long, v long").repartition(7)
    got = {r["node"]: r["root"] for r in connected(links).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1001: 1000}
    assert connected(links.filter("false")).count() == 0
