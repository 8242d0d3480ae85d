"""The pipeline, stage by stage, on a small table with planted cases."""

import corpus_pipeline as P
from pyspark.sql import functions as F

from test_alike import brute


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    extra = spark.createDataFrame([(10**7, "1234 5678 ???", "en", "src1", 13), (10**7 + 1, None, "en", "src1", 0)], docs.schema)
    seen = docs = docs.unionByName(extra)
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, data)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k + 1 < len(P.STAGES):
            assert out.columns == seen.columns
        if name == "language":
            assert out.where("doc_id >= 10000000").count() == 0 and out.count() == docs.count() - 2
        if name == "lines":
            assert out.count() == docs.count() and out.where("n_chars <> char_length(text)").count() == 0
        if name == "near_duplicates":
            rows = sorted({(r["doc_id"], r["text"]) for r in docs.collect()})
            want = brute([r[0] for r in rows], [r[1] for r in rows])
            assert sorted(r[0] for r in out.select("doc_id").collect()) == sorted({w for w in want})
        if name == "mix":
            assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
            assert out.join(docs, ["doc_id", "text"], "left_anti").count() == 0
        if name == "pieces":
            assert out.count() == docs.count() and out.where("not decoded_ok or not parity").count() == 0
        docs = out


def test_run(spark, data):
    assert P.run(spark, data).count() > 0


def test_odd_tables(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing columns go through all stages; an empty table stays empty."""
    from test_documents import empty, odd

    for n, first in enumerate((odd(spark), empty(spark))):
        docs = first
        for k, (name, stage) in enumerate(P.STAGES):
            out = stage(spark, docs, "")
            out.write.parquet(f"{tmp_path}/{n}-{k}")
            out = spark.read.parquet(f"{tmp_path}/{n}-{k}")
            assert k + 1 == len(P.STAGES) or out.columns == first.columns
            docs = out
        if n:
            assert docs.count() == 0
        else:
            assert set(first.columns) - {"text"} < set(docs.columns)
