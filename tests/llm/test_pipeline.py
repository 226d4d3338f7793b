"""The pipeline against plain versions of its stages, and the registered queries against their SQL."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
import __spark_entry__ as contract
import check
import corpus_pipeline
from tests.llm import test_line_dedup, test_simhash, test_suffix

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(11)
    vocab = [f"word{i}" for i in range(400)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(25))) for i in range(6)]
    rows, labels = [], []
    for i in range(240):
        kind = i % 8
        text = ". ".join(" ".join(rnd.choice(vocab) for _ in range(60)) for _ in range(2))
        if kind == 1:
            text = " ".join(rnd.choice(["BUY!!", "NOW!!", "$$$"]) for _ in range(60))
        elif kind == 2 and i > 8:
            text = rows[i - 8][1] + " tail"
        elif kind == 3:
            text += "\n" + items[i % 6][1]
        elif kind == 4:
            text += "\nThis footer line stands in many of these documents."
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(kind != 1), 0))
    rows += [(1000, None, None, None, None), (1001, "", "en", "s", 0)]
    out = tmp_path_factory.mktemp("tables")
    for name, data, schema in (("documents", rows, DOCS), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"file://{out}/{name}.parquet")
    return f"file://{out}", items


def test_stages_against_plain_versions(spark, folder):
    sf, items = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_duplicates", "decontamination", "bpe"]
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        rows = docs.collect()
        if name == "bpe":
            assert {r["doc_id"] for r in rows} == set(before) and all(len(r["ids"]) == 4 * r["n_tokens"] for r in rows)
            continue
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = {r["doc_id"]: r["text"] for r in rows}
        pairs = sorted(before.items())
        if name == "quality":
            assert {i for i in before if i < 1000 and i % 8 == 1} == {i for i in set(before) - set(after) if i < 1000}
        elif name == "line_dedup":
            assert after == {d: kept for d, _, _, kept in test_line_dedup.plain(pairs)} and all(r["n_chars"] == len(r["text"]) for r in rows)
        elif name == "near_duplicates":
            want = test_simhash.plain_components([(d, test_simhash.plain_print(t)) for d, t in pairs])
            assert set(after) == {d for d, _, c in want if d == c} and len(after) < len(before)
        else:
            assert set(after) == {r[0] for r in test_suffix.plain(pairs, items) if not r[5]} and len(after) < len(before)
        before = after
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()} == set(before)


def test_empty_tables(spark, folder, tmp_path):
    sf, _ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


@pytest.mark.parametrize("name", ["op1_line_dedup", "op2_mtree", "op7_suffix_decontamination", "op11_conversation_repair"])
def test_query_matches_sql(spark, name):
    df = contract.queries()[name](spark, SF)
    rel = check.duck(SF).execute(contract.oracle_sql()[name])
    columns = [d[0] for d in rel.description]
    assert check.rows(df.columns, [tuple(r) for r in df.collect()]) == check.rows(columns, rel.fetchall())


def test_every_operator_is_registered():
    names = [n.split("_")[0] for n in contract.queries() if n.startswith("op")]
    assert sorted(names) == sorted(f"op{n}" for n in range(1, 14)) and "pipeline" in contract.queries()
