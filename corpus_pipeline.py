"""From raw documents to token digests: five stages, each an operator of ``sitelens.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its
predecessor kept; its result is written as Parquet and read again as the next
stage's documents.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm import bpe, mixing, near_dedup, pii, quality_rules
from sitelens.llm import common as C

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: The name of the row number that stages join by (dropped again).
ROW = "_pipeline_row"


def _whole(docs: DataFrame) -> DataFrame:
    """Every row as one struct, so that no column of the documents meets a column of an operator."""
    return docs.select(F.struct(*docs.columns).alias("_doc"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the base rules or the learned decision list reject."""
    rules = quality_rules.fit(docs, C.read_table(spark, sf_dir, "labels"))
    judged = quality_rules.judge(_whole(docs), rules, "_doc.text")
    return judged.where("kept").select("_doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of every class of near duplicates (the first in the table)."""
    rows = C.with_row_id(_whole(docs), "pipeline-near", ROW)
    classes = near_dedup.near_duplicate_classes(rows.select(ROW, F.col("_doc.text").alias("text")), id_column=ROW)
    gone = classes.where("not kept").select(F.col("doc_id").alias(ROW))
    return rows.join(C.slim(gone, "pipeline-gone"), ROW, "left_anti").select("_doc.*")


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data, and terms that reveal it, in every text; lengths follow."""
    clean = pii.sanitise(docs)
    lengths = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return clean.withColumns(lengths) if lengths else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat every document as often as the mix takes it (not at all, once or twice)."""
    rows = C.with_row_id(_whole(docs), "pipeline-mix", ROW)
    sizes = rows.select(F.col(ROW).alias("key"), F.col("_doc.source").alias("source"), C.word_count("_doc.text").alias("size"))
    taken = mixing.mix(sizes).select(F.col("key").alias(ROW), "copies")
    times = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return rows.join(C.slim(taken.where("copies > 0"), "pipeline-taken"), ROW).select("_doc", times.alias("_copy")).select("_doc.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's ids and decoded text."""
    return bpe.encode_documents(docs, bpe.public_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_good),
    ("near_dedup", drop_near_duplicates),
    ("pii", hide_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Learned rules, similarity classes and random rounding have no SQL; tests compare the stages with plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written once and read again."""
    docs = C.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.write_once(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
