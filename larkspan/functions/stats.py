"""Summaries and fits as one-pass aggregates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.operators.select import numeric

DECILES = (0.1, 0.25, 0.5, 0.75, 0.9)
#: Parts (a power of two) that the distinct values of a column are cut into, so that no task holds them all.
PARTS = 256


def percentiles(df: DataFrame, columns: Iterable[str], qs: Iterable[float]) -> DataFrame:
    """One row: for each column an array of its interpolated quantiles, as F.percentile gives them, NULL where no value is there.

    F.percentile's one last task reads every task's distinct values. Here values are counted, cut into PARTS by approximate quantiles (which
    only balance the parts), and ranked in their part behind the values of the parts before.
    """
    names, qs = list(columns), list(map(float, qs))
    x = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")) for i, c in enumerate(names)])).alias("x")).select("x.*").where("v is not null")
    n = x.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    cuts = n.groupBy("i").agg(F.sort_array(F.percentile_approx("v", F.array(*[F.lit(k / PARTS) for k in range(1, PARTS)]), F.lit(4 * PARTS))).alias("cuts"))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(PARTS.bit_length() - 1))])  # of a binary search for the number of cuts up to v
    n = n.join(F.broadcast(cuts), "i").select("i", "v", "n", F.aggregate(steps, F.lit(0), lambda b, s: b + F.when(F.get("cuts", b + s - 1) <= F.col("v"), s).otherwise(0)).alias("b"))
    whole = Window.partitionBy("i")
    sums = n.groupBy("i", "b").agg(F.sum("n").alias("s"))  # PARTS rows a column
    sums = sums.select("i", "b", F.coalesce(F.sum("s").over(whole.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), (F.sum("s").over(whole) - 1).alias("most"))
    x = n.join(F.broadcast(sums), ["i", "b"]).withColumn("end", F.col("before") + F.sum("n").over(Window.partitionBy("i", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))

    def at(rank):
        return F.max(F.when((rank < F.col("end")) & (rank >= F.col("end") - F.col("n")), F.col("v")))

    found = []
    for q in qs:
        p = F.col("most") * F.lit(q)
        low, high = at(F.floor(p)), at(F.ceil(p))
        p = F.max("most") * F.lit(q)
        found.append(F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high))
    found = x.groupBy("i").agg(F.array(*found).alias("q"))
    return found.agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(c) for i, c in enumerate(names)])


def describe(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """(column, count, valid, missing, mean, std, min, p10, p25, p50, p75, p90, max, mean_m): a row a column. mean_m: the mean between p10 and p90."""
    names = list(columns or numeric(df))
    edges = percentiles(df, names, DECILES)
    x = df.select(*names).crossJoin(F.broadcast(edges.select(*[F.col(c).alias(f"_q_{c}") for c in names])))
    rows = []
    for c in names:
        q = F.any_value(f"_q_{c}")
        middle = F.avg(F.when(F.col(c).between(F.get(f"_q_{c}", F.lit(0)), F.get(f"_q_{c}", F.lit(4))), F.col(c).cast("double")))
        rows.append(F.struct(
            F.lit(c).alias("column"), F.count(F.lit(1)).alias("count"), F.count(c).alias("valid"), (F.count(F.lit(1)) - F.count(c)).alias("missing"), F.avg(c).cast("double").alias("mean"), F.stddev_samp(c).alias("std"),
            F.min(c).cast("double").alias("min"), *[F.get(q, F.lit(i)).alias(f"p{int(p * 100)}") for i, p in enumerate(DECILES)], F.max(c).cast("double").alias("max"), middle.alias("mean_m"),
        ).alias(c))
    return x.agg(*rows).select(F.explode(F.array(*names)).alias("x")).select("x.*")


def statx(df: DataFrame, column: str) -> DataFrame:
    """One row: quantiles, extremes, mean, population deviation and counts of the finite values."""
    c = F.col(column).cast("double")
    c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    qs = (0.001, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 0.999)
    got = percentiles(df.select(c.alias("q")), ["q"], qs)
    return df.crossJoin(F.broadcast(got.select(F.col("q").alias("_q")))).agg(F.min(c).alias("min"), F.any_value("_q").alias("q"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.count(F.lit(1)).alias("count"), (F.count(F.lit(1)) - F.count(c)).alias("nans")).select("min", *[F.get("q", F.lit(i)).alias(f"q{str(p)[2:]}") for i, p in enumerate(qs)], "max", "mean", "std", "count", "nans")


def reduce_columns(df: DataFrame, how: str, columns: Iterable[str] | None = None) -> DataFrame:
    """One row: a reduction of every column."""
    from larkspan.functions.aggregates import NAMED

    return df.agg(*[NAMED[how](c).alias(c) for c in columns or numeric(df)])


def arg_extreme(df: DataFrame, column: str, key: str, biggest: bool = False) -> DataFrame:
    """One row: the key of the least (greatest) value, the smallest key of ties."""
    if biggest:
        return df.where(F.col(column).isNotNull()).orderBy(F.desc(column), key).limit(1).select(F.col(key).alias("arg"))
    return df.where(F.col(column).isNotNull()).agg(F.min_by(key, F.struct(column, key)).alias("arg"))


r2 = lambda a, b: F.pow(F.corr(a, b), 2)
mae = lambda a, b: F.avg(F.abs(a - b))
class_error = lambda a, b: F.avg((F.round(a) != F.round(b)).cast("double"))


def line(y: Column, x: Column) -> tuple[Column, Column]:
    """(slope, intercept) of the least-squares line, as aggregates."""
    return F.regr_slope(y, x), F.regr_intercept(y, x)


def least_squares(df: DataFrame, y: str, xs: list[str], intercept: bool = True) -> DataFrame:
    """(term, weight). One pass sums the products of the columns; the driver solves a system as wide as there are terms."""
    import numpy as np

    terms = [F.col(x).cast("double") for x in xs] + ([F.lit(1.0)] if intercept else [])
    whole = df.dropna(subset=[y, *xs])
    sums = whole.agg(*[F.sum(a * b).alias(f"p{i}_{j}") for i, a in enumerate(terms) for j, b in enumerate(terms) if j >= i], *[F.sum(a * F.col(y)).alias(f"y{i}") for i, a in enumerate(terms)]).first()
    n = len(terms)
    a = np.array([[sums[f"p{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)])
    b = np.array([sums[f"y{i}"] or 0.0 for i in range(n)])
    w = np.linalg.lstsq(a, b, rcond=None)[0]
    return df.sparkSession.createDataFrame(list(zip([*xs, *(["intercept"] if intercept else [])], map(float, w), strict=True)), "term string, weight double")


def polynomial(df: DataFrame, y: str, x: str, degree: int) -> DataFrame:
    made = df.select(y, *[F.pow(F.col(x), F.lit(k)).alias(f"{x}^{k}") for k in range(degree, 0, -1)])
    return least_squares(made, y, made.columns[1:])
