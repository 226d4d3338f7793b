import random

import numpy as np

from galeframe.llm.bpe_fragments import Codec, read_tokenizer
from galeframe.llm.packing import best_fit_decreasing, pack_documents, position_ids


def test_best_fit_against_plain_search():
    rnd = random.Random(3)
    for _ in range(200):
        length = rnd.choice([1, 2, 7, 16, 63, 64, 65, 200])
        sizes = [rnd.randint(1, length) for _ in range(rnd.randint(0, 60))]
        free = []
        for s in sorted(sizes, reverse=True):
            fit = [f for f in free if f >= s]
            if fit:
                free[free.index(min(fit))] -= s
            else:
                free.append(length - s)
        rows = best_fit_decreasing(sizes, length)
        assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
        assert sorted(length - sum(sizes[i] for i in r) for r in rows) == sorted(free)


def test_round_trip(spark, odd, empty, tokenizer_path):
    codec = Codec(read_tokenizer(tokenizer_path))
    docs = spark.createDataFrame([(i, "some words of a document " * (i % 37)) for i in range(300)], "doc_id long, text string").union(odd.filter("doc_id > 0").select("doc_id", "text").distinct().filter("doc_id < 9").selectExpr("doc_id + 1000", "text"))
    for settings in ({"length": 64}, {"length": 2048, "buffer_tokens": 5000}):
        rows = pack_documents(docs, tokenizer_path, **settings).collect()
        assert len({r["row_id"] for r in rows}) == len(rows)
        pieces = {}
        for r in rows:
            ids, cu = np.frombuffer(r["ids"], "<u2"), r["cu_seqlens"]
            assert len(ids) == settings["length"] and cu[0] == 0 and cu[-1] == r["n_tokens"] <= settings["length"] and (ids[cu[-1]:] == 49407).all()
            assert r["position_resets"] == cu[:-1] and r["n_segments"] == len(r["doc_ids"]) == len(cu) - 1
            assert all(position_ids(np.array(cu))[c] == 0 for c in cu[:-1])
            for d, o, s, e in zip(r["doc_ids"], r["doc_offsets"], cu, cu[1:]):
                assert (d, o) not in pieces
                pieces[d, o] = ids[s:e]
        for d, t in docs.collect():
            want = np.frombuffer(codec.encode([t])[0], "<u4").tolist()
            got = np.concatenate([pieces[k] for k in sorted(k for k in pieces if k[0] == d)] or [[]]).astype(int).tolist()
            assert got == (want + [49407] if want else [])
    assert pack_documents(empty, tokenizer_path).count() == 0
    repeated = pack_documents(odd, tokenizer_path, length=64).collect()
    assert sum(d == 6 for r in repeated for d in r["doc_ids"]) == 2
