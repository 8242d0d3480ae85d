"""Operator 6, mixing sources to target weights by systematic sampling: prefix sums of expected copies, one offset a source, one copy for each integer passed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspan.llm.shared import WORD, named, numbered, spool

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A source gives at most so many times its size.
MOST = 3.0
#: Expected copies are kept as multiples of 2 to the power -24, so that sums are exact in any order.
UNIT = 1 << 24


def targets(blocks: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, words) -> (source, source_size, target): shares by weight of all words, capped at most * size, the excess reshared until none is above.

    With caps c and weights w, sources in order of c / w: those below the level are full, the rest get w * level; the level follows from prefix sums.
    Works on one row a source.
    """
    s = blocks.groupBy("source").agg(F.sum("words").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = s.select("source", "source_size", w.alias("w"), (F.col("source_size") * most).alias("cap"))
    full = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    # a source is free if the level it would see is no more than its own cap / w; the level of the first free source holds for all free ones
    s = s.select("*", level.alias("level"), (level <= F.col("cap") / F.col("w")).alias("free"))
    held = F.min(F.when(F.col("free"), F.struct((F.col("cap") / F.col("w")).alias("at"), F.col("level").alias("level")))).over(every)["level"]
    return s.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("w") * held, F.col("cap"))).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, most: float = MOST, seed: int = 17, buckets: int = 64) -> DataFrame:
    """docs plus mix_size, mix_source_size, mix_target, mix_copies (0 to most): how often the mix takes each document.

    Documents stand in order of size class (32 to a power of two), then of one of `buckets` hash buckets of the id, then of size and id. The expected
    copies of a document are its source's target over its size; prefix sums run inside (source, class, bucket) and over the sums
    of these blocks, so that no task gets a source. Nulls: a null text has size 0, a null source is a source, null ids are alike.
    Repeated rows and ids count each. Sources of size 0 have target 0 and are not taken. Same rows, same result. An empty table stays empty.
    Other columns are kept, whatever their
    names; the four replace columns of these names.
    """
    x, at = numbered(docs)
    x = x.withColumns({"source": F.col(at["source"]), "mix_size": F.coalesce(F.regexp_count(at["text"], F.lit(WORD)), F.lit(0)).cast("long")})
    x = x.withColumns({
        "mix_class": F.when(F.col("mix_size") > 0, F.floor(F.log2(F.col("mix_size").cast("double")) * 32)).otherwise(F.lit(-1)).cast("int"),
        "mix_bucket": F.pmod(F.xxhash64(F.col(at["doc_id"]), F.lit(seed)), F.lit(buckets)).cast("int"),
    })
    key = ["source", "mix_class", "mix_bucket"]
    blocks = spool(x.groupBy(*key).agg(F.count("*").alias("n"), F.sum("mix_size").alias("words")), "blocks")
    t = targets(blocks, weights, most)
    unit = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * UNIT)).otherwise(F.lit(0)).cast("long")
    t = t.select(F.col("source").alias("t_source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), unit.alias("mix_each"))
    before = Window.partitionBy("source").orderBy("mix_class", "mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    b = blocks.select(*key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("mix_before"))
    b = b.join(t, F.col("source").eqNullSafe(F.col("t_source"))).select(*[F.col(k).alias(f"b_{k}") for k in key], "mix_before", "mix_source_size", "mix_target", "mix_each")
    inside = Window.partitionBy(*key).orderBy("mix_size", at["doc_id"], F.xxhash64(at["text"]))
    x = x.withColumn("mix_row", F.row_number().over(inside))
    x = x.join(b, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("mix_class") == F.col("b_mix_class")) & (F.col("mix_bucket") == F.col("b_mix_bucket")))
    offset = F.pmod(F.xxhash64(F.col("source"), F.lit(seed + 1)), F.lit(UNIT))
    whole = lambda n: F.shiftright(n * F.col("mix_each") + offset, 24)
    last = F.col("mix_before") + F.col("mix_row")
    copies = whole(last) - whole(last - 1)
    return named(x, at, mix_size=F.col("mix_size"), mix_source_size=F.col("mix_source_size"), mix_target=F.col("mix_target"), mix_copies=copies)


def copies(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of docs."""
    x, at = numbered(docs)
    own = {c: at[c] for c in ("doc_id", "source", "text")}
    x = mix(x.withColumnsRenamed({k: c for c, k in own.items()}), **how).where("mix_copies > 0")
    x = x.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))))
    return x.select(*[F.col(c if c in own else k).alias(c) for c, k in at.items()])
