import random
import re

from pyspark.sql import functions as F

from galeframe.llm.line_dedup import LineRuns, dedup_lines, line_table
from galeframe.llm.plans import op1  # noqa: F401 - registered


def plain(rows):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    def key(line):
        return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(fold)
    low = lambda d: -(2**63) if d is None else d
    holders, last = {}, {}
    for d, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 20:
                holders[k] = holders.get(k, 0) + 1
                last[k] = max(last.get(k, -(2**63)), low(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(key(x)) >= 20 and holders[key(x)] >= 3 and low(d) < last[key(x)])]
        out.append((d, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in df.collect()), key=str)


def test_against_plain_version(spark):
    rnd = random.Random(2)
    pool = [f"{c} shared line number {i} of the pool" for i in range(12) for c in ("A", "a", "É")] + ["short", "", "\t  Padded SHARED line number one \r"]
    rows = [(i * 7 - 50, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 9)))) for i in range(120)]
    rows += [(5000, "\n".join(["the very common line of all documents"] * 3))] * 2 + [(i, "the very common line of all documents\n") for i in range(6000, 6100)]
    for batches in (1, 3, 7):
        assert found(dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), batches=batches)) == plain(rows)


def test_odd_rows(odd, empty):
    assert found(dedup_lines(odd)) == plain([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert dedup_lines(empty).count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([(i, "a line that is long enough to count", i, "x", 9) for i in range(4)], "doc_id long, text string, pos int, kept string, _hash int")
    out = dedup_lines(df)
    assert out.columns == ["doc_id", "text", "pos", "_hash", "kept", "n_lines", "n_dropped"]
    assert {(r["doc_id"], r["n_dropped"], r["pos"], r["_hash"]) for r in out.collect()} == {(i, int(i < 3), i, 9) for i in range(4)}


def test_runs_are_disjoint_and_compacted(spark):
    docs = spark.createDataFrame([(i, f"line number {i % 7:04d} of this test\nanother line {i:05d} alone") for i in range(40)], "doc_id long, text string")
    lines, store = line_table(docs).cache(), LineRuns(spark)
    fresh = [store.add(lines.filter(F.pmod("_doc", F.lit(5)) == b)).count() for b in range(5)]
    assert sum(fresh) == lines.select("h1", "h2").distinct().count() and len(store.runs()) == 2  # 5 = 4 + 1 batches
    together = store.runs()[0].unionByName(store.runs()[1])
    assert together.count() == together.select("h1", "h2").distinct().count()
    assert store.totals().agg(F.sum("n_docs")).first()[0] == lines.filter("first").count()


def test_native_plan(odd):
    plan = dedup_lines(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
