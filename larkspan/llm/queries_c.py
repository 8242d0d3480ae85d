"""Queries of the corpus operators (pieces, lines, near-duplicates); each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm import lines, pieces, simhash


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pieces.encode(docs, check_every=1).drop("text")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return lines.drop_lines(docs)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return simhash.groups(docs).select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES = {"op2_pieces": op2_pieces, "op3_line_dedup": op3_line_dedup, "op8_simhash": op8_simhash}
SQL: dict = {}
