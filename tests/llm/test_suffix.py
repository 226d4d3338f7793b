import hashlib
import random
import re

import numpy as np

from galeframe.llm.suffix_decontam import Windows, clean_documents, contamination, search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(FOLD))


def plain(docs, items, size=10):
    out = []
    for d, t in docs:
        w, hit, names = words(t), set(), set()
        for item, it in items:
            iw = words(it)
            for s in range(max(1, len(iw) - size + 1) if iw else 0):
                g = iw[s:s + size]
                for p in range(len(w) - len(g) + 1):
                    if w[p:p + len(g)] == g:
                        hit |= set(range(p, p + len(g)))
                        names.add(item)
        text = ",".join(sorted(str(n) for n in names))
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(text.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in df.collect()), key=str)


def cases():
    rnd = random.Random(4)
    vocab = ["a", "b", "Cé", "x1"]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 30)))) for i in range(8)] + [(20, "only few words"), (21, "only few words"), (22, None), (23, "...")]
    docs = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 60)))) for i in range(40)]
    docs += [(100 + i, f"pre{i}, " + items[i][1].upper().replace(" ", "--") + " post") for i in range(8)] + [(200, "Only FEW words only few words")]
    return docs, items


def test_against_plain_version(spark):
    docs, items = cases()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert found(contamination(d, b)) == plain(docs, items)
    assert found(contamination(d, b, block_words=1, shard_words=5)) == plain(docs, items)  # many blocks, many shards
    clean = {r[0] for r in plain(docs, items) if not r[5]}
    assert {r["doc_id"] for r in clean_documents(d, b).collect()} == clean


def test_longest_match_and_spans(spark):
    item = " ".join(f"w{i}" for i in range(30))
    d = spark.createDataFrame([(1, "intro " + " ".join(f"w{i}" for i in range(5, 27)) + " tail")], "doc_id long, text string")
    r = contamination(d, spark.createDataFrame([(1, item)], "item_id long, text string")).first()
    assert r["longest_match"] == 22 and [tuple(s) for s in r["spans"]] == [(1, 23)] and r["n_hit"] == 22


def test_odd_rows(spark, odd, empty):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    items = [(None, "one two"), (1, "ÄÖ"), (2, None)]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = found(contamination(odd, b))
    want = plain(docs, items)
    assert [r[:3] + (r[5],) for r in got] == [r[:3] + (r[5],) for r in want]
    assert contamination(empty, b).count() == 0
    assert not any(r[5] for r in found(contamination(odd, b.filter("false"))))
    wide = odd.selectExpr("*", "1 AS found", "2 AS row")
    assert clean_documents(wide, b).columns == wide.columns


def test_search_finds_every_occurrence():
    rnd = np.random.default_rng(1)
    win = Windows([(1, "a b a b a b a b a b a"), (2, "b a")])
    tokens = rnd.integers(0, 3, 500).astype(np.int32)
    pos, which = search(tokens, win)
    grams = list({tuple(win.vocab[w] for w in g) for g in ([b"a", b"b"] * 5, [b"b", b"a"] * 5, [b"b", b"a"])})
    want = {(p, len(g)) for g in grams for p in range(len(tokens)) if tuple(tokens[p:p + len(g)]) == g}
    assert {(int(p), int(win.length[w])) for p, w in zip(pos, which)} == want
