"""Queries of the corpus operators (languages, mixing, chats); each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm import chat, language, mixing
from larkspan.llm.shared import id_crc


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = F.pmod(id_crc(F.col("doc_id")), F.lit(4)) == 2
    profiles = language.fit(docs.select("doc_id", "text", "lang").where(~out))
    found = language.identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mixing.mix(docs.select("doc_id", "source", "text"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.sql("select -7L conv_id, 0L turn, 'user' role, '</s>[INST] ok [/INST]' text union all select -7L, 1L, 'assistant', '</s>[INST] ok [/INST]'")
    back = chat.read_back(chat.format_chats(rows.unionAll(extra)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars", "valid",
    )


_ESCAPED = r"""regexp_replace(regexp_replace(text, '\\', '\\\\', 'g'), '(<)(<SYS>>|</SYS>>|s>|/s>)|(\[)(INST\]|/INST\]|ROLE\]|/ROLE\]|END\])', '\1\3\\\2\4', 'g')"""

SQL = {
    "op10_chat_format": rf"""
with rows as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), x as (
    select *, length({_ESCAPED}) + case role when 'system' then 17 when 'user' then 15 when 'assistant' then 9 else 22 + length(role) end as n,
        lag(role, 1, '') over w as before, lead(role) over w as after
    from rows window w as (partition by conv_id order by turn nulls first, role, text)
)
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
    coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
    sum(n)::bigint as formatted_chars,
    bool_and(case before when '' then role in ('system', 'user') when 'system' then role = 'user' when 'user' then role = 'assistant' when 'assistant' then role = 'user' else false end
        and (after is not null or role = 'assistant')) as valid
from x group by conv_id""",
}
QUERIES = {"op4_language_id": op4_language_id, "op6_mix_sources": op6_mix_sources, "op10_chat_format": op10_chat_format}
