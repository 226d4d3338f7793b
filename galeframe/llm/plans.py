"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.llm import bpe_fragments, conversation_repair, line_dedup, mtree, packing, pii_crf, prefix_forest, quality_gbt, sharding, simhash, site_template, suffix_decontam, whitening
from galeframe.llm.common import table
from galeframe.plans.registry import ORACLE, QUERIES, Query

TOKENIZERS = "/opt/tokenizers"
WORD_BPE = f"{TOKENIZERS}/word_bpe_49k.json"
FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, sql: str | None = None):
    def wrap(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return wrap


LINES_SQL = f"""
WITH lines AS (
  SELECT doc_id, pos, list_extract(parts, pos) AS line FROM (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos FROM documents)),
keyed AS (
  SELECT *, {FOLD.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k FROM lines),
heavy AS (
  SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT keyed.doc_id, pos, line, last_doc IS NOT NULL AND keyed.doc_id < last_doc AS gone FROM keyed LEFT JOIN heavy ON keyed.k = heavy.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


@query("op1_line_dedup", LINES_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


TOP_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
met AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM met)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10"""


@query("op2_mtree", TOP_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"))


@query("op3_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_BPE)


@query("op4_pii_crf")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.find_personal_data(table(spark, sf_dir, "documents"))


@query("op5_site_template")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_template.extract_text(table(spark, sf_dir, "pages"))


@query("op6_bpe_fragments")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_fragments.encode_documents(table(spark, sf_dir, "documents"), WORD_BPE)


WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
CONTAMINATION_SQL = f"""
WITH items AS (
  SELECT item_id, regexp_extract_all({FOLD.format("coalesce(text, '')")}, {WORD}) AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS grams
  FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM items WHERE len(w) > 0)),
docs AS (
  SELECT doc_id, regexp_extract_all({FOLD.format("coalesce(text, '')")}, {WORD}) AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM windows),
starts AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS grams
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs, sizes WHERE len(w) >= n)),
met AS (SELECT doc_id, item_id, starts.n, s FROM starts JOIN windows ON starts.grams = windows.grams AND starts.n = windows.n),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM met) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM met) GROUP BY doc_id)
SELECT docs.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)"""


@query("op7_suffix_decontamination", CONTAMINATION_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op8_quality_trees")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_gbt.score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), quality_gbt.held_out("doc_id").alias("held_out"), "score", "predicted")


@query("op9_simhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_classes(table(spark, sf_dir, "documents"))


@query("op10_sharding")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def _least(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


def _way(cost: str, audit: str, lines: str) -> str:
    return "{" + f"'c': {cost}, 'a': {audit}, 't': {lines}" + "}"


def _row(state: str, keeps: dict[str, str], then: str, name: str) -> str:
    """The least (cost, audit, lines) of a row in a state: deleted, kept by its initial, or given a role."""
    body = "CASE WHEN NOT gone THEN {} END"
    kept = [f"CASE WHEN NOT gone AND x = '{i}' THEN {_way(f'l3+n.{q}.c', f"'K' || n.{q}.a", f"list_prepend(role || ':' || text, n.{q}.t)")} END" for i, q in keeps.items()]
    given = body.format(_way(f"l3+3+n.{then}.c", f"'R' || n.{then}.a", f"list_prepend('{name}:' || text, n.{then}.t)"))
    ways = [_way(f"4+n.{state}.c", f"'D' || n.{state}.a", f"n.{state}.t"), *kept, given]
    return f"list_sort(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))[1]"


def _insert(value: str, after: str, name: str) -> str:
    return _least(value, _way(f"3+{after}.c", f"'I' || {after}.a", f"list_prepend('{name}:', {after}.t)"))


REPAIR_SQL = f"""
WITH RECURSIVE named AS (
  SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda h: ascii(h)::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 20 AS d FROM named),
hurt AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy FROM hashed WHERE d <> 0),
placed AS (
  SELECT *, row_number() OVER w AS i, left(role, 1) AS x, lag(left(role, 1)) OVER w AS before, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again
  FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy)),
judged AS (
  SELECT *, body = '' AS blank, body <> '' AND again AS twice, body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS late, body = '' OR again AS gone,
    before IS NOT NULL AND before || x NOT IN ('su', 'ua', 'au') AS odd FROM placed),
counted AS (
  SELECT conv_id, count(*) AS size, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE blank) AS blank,
    count(*) FILTER (WHERE twice) AS duplicate, count(*) FILTER (WHERE late) AS truncated, count(*) FILTER (WHERE odd) AS illegal FROM judged GROUP BY conv_id),
walk AS (
  SELECT conv_id, size + 1 AS i, {{'q': {_way("0", "''", "[]::VARCHAR[]")}, 's': {_way("6", "'II'", "['user:', 'assistant:']")},
    'u': {_way("3", "'I'", "['assistant:']")}, 'a': {_way("0", "''", "[]::VARCHAR[]")}}} AS n FROM counted
  UNION ALL
  SELECT conv_id, i, {{'q': {_insert("p.q", "u1", "user")}, 's': {_insert("p.s", "u1", "user")}, 'u': u1, 'a': {_insert("p.a", "p.u", "user")}}} FROM (
    SELECT conv_id, i, p, {_insert("p.u", "p.a", "assistant")} AS u1 FROM (
      SELECT conv_id, j.i, {{'q': {_row("q", {"s": "s", "u": "u"}, "u", "user")}, 's': {_row("s", {"u": "u"}, "u", "user")},
        'u': {_row("u", {"a": "a"}, "a", "assistant")}, 'a': {_row("a", {"u": "u"}, "u", "user")}}} AS p
      FROM (SELECT w.conv_id, w.n, j.i, j.role, j.text, j.x, j.gone, 3 * j.late::INTEGER AS l3 FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i - 1) j)))
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(n.q.c, 0)::BIGINT AS cost, coalesce(n.q.a, '') AS audit, sha256(coalesce(array_to_string(n.q.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN walk w ON w.conv_id IS NOT DISTINCT FROM o.conv_id AND w.i = 1"""


@query("op11_conversation_repair", REPAIR_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_conversations(table(spark, sf_dir, "conversations"))


@query("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op13_prefix_forest")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_forest.nearest(table(spark, sf_dir, "embeddings"))
