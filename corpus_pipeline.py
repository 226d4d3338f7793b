"""From raw documents to token ids: five stages, each a table written before the next one reads it.

The quality stage keeps what the fitted trees accept, which SQL cannot express, so there is no SQL for the pipeline; the
tests compare it with the plain versions of its stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.llm.bpe_fragments import encode_documents
from galeframe.llm.common import stash, table
from galeframe.llm.line_dedup import dedup_lines
from galeframe.llm.plans import WORD_BPE
from galeframe.llm.quality_gbt import score_quality
from galeframe.llm.simhash import one_per_component
from galeframe.llm.suffix_decontam import clean_documents


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality trees accept."""
    scored = score_quality(docs, table(spark, sf_dir, "labels"), score="_quality_score", predicted="_quality_label")
    return scored.filter("_quality_label = 1").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that a later document holds too."""
    changed = {"text": F.col("kept").alias("text"), "n_chars": F.char_length("kept").cast("long").alias("n_chars")}
    return dedup_lines(docs).select(*(changed.get(c, F.col(c)) for c in docs.columns))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    return one_per_component(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of the ids and of the decoded text."""
    return encode_documents(docs, WORD_BPE, with_ids=True)


STAGES = [
    ("quality", accept_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
