"""Language ID, line dedup, near-dedup, decontamination and packing, one after the other.

Each stage gets what its predecessor kept, all of it, with the columns of documents; the last returns
the packed pieces. A document that had words, and whose lines are all repeats of earlier ones, goes in line dedup; one that had none stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm import decontamination, language_id, line_dedup, near_dedup, packing
from braidwork.llm.common import documents, written
from braidwork.session import ship


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the models learn from the stage's own input."""
    ship(spark)
    return language_id.filter_known(docs, language_id.fit(docs.where(~language_id.held_out())))


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier line resembles; n_chars follows the text. A text of which no word is left is a repeat and goes."""
    ship(spark)
    words = lambda c: F.col(c).rlike(r"[^\x20\x09-\x0D]")
    mark = "_".join(["had_words", *docs.columns])  # no column's name
    left = line_dedup.dedup_lines(docs.withColumn(mark, F.coalesce(words("text"), F.lit(False))))
    left = left.where(~F.col(f"`{mark}`") | F.coalesce(words("text"), F.lit(False)))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near-duplicates."""
    ship(spark)
    return near_dedup.dedup(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    ship(spark)
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, with their sequence and place."""
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", known_language),
    ("line dedup", unrepeated_lines),
    ("MinHash near-dedup", one_of_each_group),
    ("benchmark decontamination", uncontaminated),
    ("best-fit packing", packed),
]

ORACLE_SQL = None  # language models and the vocabulary's merges are not SQL's to express


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, out, sf_dir)
        if k + 1 < len(STAGES):
            out = written(out, f"stage{k + 1}")
    return out
