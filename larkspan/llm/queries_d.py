"""Queries of the corpus operators (vectors); each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspan.llm import nearvectors, topk


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearvectors.group(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def near_vectors_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5 on the table and a changed copy of each vector, whose cosine with it is 0.92 to 0.998, so that there are links to find."""
    x = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    y = x.selectExpr("vec_id + 1000000000 as vec_id", "transform(embedding, (x, i) -> cast(cast(x as double) * (1 + (vec_id % 5 + 1) / 10 * (i % 3 - 1)) as float)) as embedding")
    return nearvectors.group(x.unionAll(y))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return topk.search(rows, rows.where("vec_id % 100 = 0"))


_GROUPS = """
), g as (
    select vec_id, v from x where len(v) > 0 and len(list_filter(v, lambda y: y is null or not isfinite(y))) = 0 and len(list_filter(v, lambda y: y <> 0)) > 0
), e as materialized (
    select a.vec_id as a, b.vec_id as b from g a join g b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where list_cosine_similarity(a.v, b.v) >= 0.95
), r(id, root) as (
    select vec_id, vec_id from x union select e.b, r.root from r join e on e.a = r.id where r.root < e.b
)
select x.vec_id, coalesce((select count(*) from e where e.a = x.vec_id), 0) as n_links,
    least(x.vec_id, (select min(root) from r where r.id = x.vec_id)) as component_id,
    x.vec_id = least(x.vec_id, (select min(root) from r where r.id = x.vec_id)) as kept
from x"""

SQL = {
    "op7_topk": """
with x as (
    select vec_id, list_transform(embedding, lambda y: floor(1024 * y::double)::bigint) as v from embeddings
    where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda y: y is null or not isfinite(y))) = 0
), s as (
    select q.vec_id as query_id, c.vec_id as vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
    from x q join x c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 100 = 0
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10""",
    "op5_near_vectors": "with recursive x as (select vec_id, list_transform(embedding, lambda y: y::double) as v from embeddings" + _GROUPS,
    "near_vectors_planted": """
with recursive x as (
    select vec_id, list_transform(embedding, lambda y: y::double) as v from embeddings
    union all select vec_id + 1000000000, list_transform(embedding, lambda y, i: (y::double * (1 + (vec_id % 5 + 1) / 10 * ((i - 1) % 3 - 1)))::float::double) from embeddings""" + _GROUPS,
}
QUERIES = {"op5_near_vectors": op5_near_vectors, "near_vectors_planted": near_vectors_planted, "op7_topk": op7_topk}
