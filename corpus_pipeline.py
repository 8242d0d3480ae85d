"""The corpus pipeline: STAGES over documents, each stage's rows written as Parquet and read again as the next one's documents.

Every stage but the last returns the columns of its documents, others than those of the table too. An empty table gives an empty table. ORACLE_SQL is None: rank-order profiles, SimHash groups and pieces are not
expressible in SQL; tests hold the stages against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm import alike, language, lines, mixing, pieces
from larkspan.llm.shared import spool

#: Texts in no language of the profiles score under this and go, as do texts without a letter.
LEAST_SCORE = 0.1


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only documents in a known language stay. Null and empty texts and texts without a letter go; repeated rows and other columns stay; a tie of languages goes to the first by name."""
    profiles = language.fit(docs.select("doc_id", "text", "lang"))
    found = language.identify(docs, profiles)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("lang_score") >= LEAST_SCORE)).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from the texts; n_chars follows. No row goes: null texts stay null, empty ones empty; repeated rows get the same result."""
    return lines.drop_lines(docs).withColumn("n_chars", F.when(F.col("lines_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, similarity of 0.8 or more; rows and odd values as keep_one says."""
    return alike.keep_one(docs, shingle=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Null texts have no words but count as rows of their source; a null source is a source; repeated rows count each."""
    return mixing.copies(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of whole texts, instead of the texts. Null texts have null ids, empty ones none; repeated rows stay."""
    return pieces.encode(docs).drop("text")


STAGES = [("language", identify_language), ("lines", dedup_lines), ("near_duplicates", dedup_near), ("mix", mix), ("pieces", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = spool(docs, name)
    return docs
