"""Queries of the corpus operators (pages, language models); each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm import htmltext, pitmanyor
from larkspan.llm.shared import id_crc


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


def op9_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pitmanyor.score(docs, F.pmod(id_crc(F.col("doc_id")), F.lit(10)) == 0)


QUERIES = {"op1_html_text": op1_html_text, "op9_pitman_yor": op9_pitman_yor}
SQL: dict = {}
