"""Row-preserving operations in the order of their group: rolling, running, shifting, filling, decaying.

Each returns df with one more column. keys may be empty: then all rows are one sequence in one task; use prefix_sum for running sums of large tables.
Windows at a group's start are partial. Sums of nothing are 0. Strict forms give NULL if a value in the frame is missing.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspan.functions.aggregates import midpoint
from larkspan.operators.select import free


def _list(x) -> list:
    return [x] if isinstance(x, (str, Column)) else list(x)


def _over(keys, order) -> WindowSpec:
    return Window.partitionBy(*_list(keys)).orderBy(*_list(order))


def rolling(df: DataFrame, column: str, how: str, keys, order, window: int = 3, name: str | None = None, strict: bool = False, min_count: int = 0) -> DataFrame:
    """how: sum, mean, min, max, var, std, count, median. min_count: NULL for frames with fewer values that are there."""
    w = _over(keys, order).rowsBetween(1 - window, 0)
    c = F.col(column)
    made = {"sum": F.coalesce(F.sum(c).over(w), F.lit(0)), "mean": F.avg(c).over(w), "min": F.min(c).over(w), "max": F.max(c).over(w), "var": F.var_samp(c).over(w), "std": F.stddev_samp(c).over(w), "count": F.count(c).over(w)}
    out = midpoint(F.sort_array(F.collect_list(c).over(w)), 0.5) if how == "median" else made[how]
    if strict:
        out = F.when(F.count(c).over(w) == F.count(F.lit(1)).over(w), out)
    if min_count:
        out = F.when(F.count(c).over(w) >= min_count, out)
    return df.withColumn(name or f"rolling_{how}", out)


def rolling_quantile(df: DataFrame, column: str, q, keys, order, window: int) -> DataFrame:
    """Midpoint quantiles of the values in the frame, as column_q0_25 and so on."""
    held = F.sort_array(F.collect_list(column).over(_over(keys, order).rowsBetween(1 - window, 0)))
    qs = q if isinstance(q, (list, tuple)) else [q]
    return df.withColumn("_held", held).withColumns({f"{column}_q{str(x).replace('.', '_')}": midpoint(F.col("_held"), x) for x in qs}).drop("_held")


def rolling_arg(df: DataFrame, column: str, keys, order, window: int, biggest: bool = False, name: str = "arg") -> DataFrame:
    """Rows back to the frame's least or greatest value, the nearest of ties."""
    w = _over(keys, order)
    x = df.withColumn("_r", F.row_number().over(w))
    pick = (F.max_by if biggest else F.min_by)(F.col("_r"), F.when(F.col(column).isNotNull(), F.struct(F.col(column), (F.col("_r") if biggest else -F.col("_r")).alias("r")))).over(w.rowsBetween(1 - window, 0))
    return x.withColumn(name, F.col("_r") - pick).drop("_r")


def cumulate(df: DataFrame, column: str, how: str, keys, order, keep: Column | None = None, reset: Column | None = None, name: str | None = None, skipna: bool = True) -> DataFrame:
    """how: sum, prod, min, max, count (rows so far, from 0). Rows that keep leaves out carry the value on (count: NULL there). reset starts anew at its rows."""
    keys = _list(keys)
    name = name or f"cum{how}"
    x = df
    if reset is not None:
        x = x.withColumn("_part", F.coalesce(F.sum(reset.cast("int")).over(_over(keys, order).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
        keys = [*keys, "_part"]
    if how == "count":
        if keep is None:
            out = F.row_number().over(_over(keys, order)) - 1
        else:
            out = F.when(keep, F.sum(F.when(keep, 1).otherwise(0)).over(_over(keys, order).rowsBetween(Window.unboundedPreceding, 0)) - 1)
        return x.withColumn(name, out.cast("long")).drop("_part")
    w = _over(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    c = F.col(column) if keep is None else F.when(keep, F.col(column))
    out = {"sum": lambda: F.coalesce(F.sum(c).over(w), F.lit(0)), "prod": lambda: F.coalesce(F.product(c).over(w), F.lit(1.0)), "min": lambda: F.min(c).over(w), "max": lambda: F.max(c).over(w)}[how]()
    if not skipna:
        missing = F.col(column).isNull() if keep is None else keep & F.col(column).isNull()
        out = F.when(F.max(missing.cast("int")).over(w) == 0, out)
    return x.withColumn(name, out).drop("_part")


def find_nth(df: DataFrame, keep: Column, keys, order, name: str = "nth") -> DataFrame:
    """Which row of its group that keep holds for this is, from 1; 0 for others."""
    return df.withColumn(name, F.when(keep, F.sum(F.when(keep, 1).otherwise(0)).over(_over(keys, order).rowsBetween(Window.unboundedPreceding, 0))).otherwise(0).cast("long"))


def shift(df: DataFrame, column: str, keys, order, n: int = 1, keep: Column | None = None, name: str = "shifted") -> DataFrame:
    """The value n rows before (after, if negative). Rows that keep leaves out are passed over and get NULL."""
    if keep is None:
        return df.withColumn(name, F.lag(column, n).over(_over(keys, order)))
    x = df.withColumn("_keep", F.coalesce(keep, F.lit(False)))
    return x.withColumn(name, F.when(F.col("_keep"), F.lag(column, n).over(_over([*_list(keys), "_keep"], order)))).drop("_keep")


def diff(df: DataFrame, column: str, keys, order, n: int = 1, name: str = "diff") -> DataFrame:
    return df.withColumn(name, F.col(column) - F.lag(column, n).over(_over(keys, order)))


def differs(df: DataFrame, column: str, keys, order, name: str = "differs", same: bool = False) -> DataFrame:
    """Whether the value is another than the one before (same: whether it is equal); missing values are equal. The first row: false."""
    w = _over(keys, order)
    equal = F.col(column).eqNullSafe(F.lag(column).over(w))
    return df.withColumn(name, F.when(F.row_number().over(w) == 1, False).otherwise(equal if same else ~equal))


def fill(df: DataFrame, column: str, keys, order, forward: bool = True, limit: int | None = None, value=None, name: str | None = None) -> DataFrame:
    """Missing values from the nearest valid row before (or after), at most limit rows away; value where there is none at all."""
    w = _over(keys, order)
    if forward:
        near, whole = w.rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0), w.rowsBetween(Window.unboundedPreceding, 0)
        pick = lambda f: F.last(column, True).over(f)
    else:
        near, whole = w.rowsBetween(0, Window.unboundedFollowing if limit is None else limit), w.rowsBetween(0, Window.unboundedFollowing)
        pick = lambda f: F.first(column, True).over(f)
    out = pick(near)
    if value is not None:
        out = F.when(pick(whole).isNull(), F.lit(value)).otherwise(out)
    return df.withColumn(name or column, out)


def time_window(df: DataFrame, column: str, keys, time: Column | str, distance, how: str = "sum", name: str = "window") -> DataFrame:
    """Sum or product over rows whose time is in [t - distance, t]; rows of equal time are in each other's window."""
    w = Window.partitionBy(*_list(keys)).orderBy(time).rangeBetween(-distance, 0)
    return df.withColumn(name, F.coalesce(F.sum(column).over(w), F.lit(0)) if how == "sum" else F.coalesce(F.product(F.col(column)).over(w), F.lit(1.0)))


def ema(df: DataFrame, column: str, keys, order: str, rate: float, how: str = "decay", time: str | None = None, keep: Column | None = None, reset: Column | None = None, name: str = "ema") -> DataFrame:
    """Exponential averages in order. Rows are dealt by their keys, sorted, and go by in Arrow batches with one carried state, so no group is held in memory.

    decay: out = x + out * exp(-rate * dt), from 0. normal: out = x * (1 - w) + out * w with w = exp(-rate * dt), from the first x. weighted: the
    same with w = rate and no time. Missing or left-out values are 0 for decay and leave the other two unchanged. reset starts anew.
    """
    keys, rate = _list(keys), float(rate)
    kept = [c for c in df.columns if c != name]
    k, j, t, x, z = (free(df, f"_{c}") for c in "kjtxz")
    # two hashes tell neighbouring keys apart
    rows = df.select(
        *kept, F.xxhash64(F.lit(1), *keys).alias(k), F.xxhash64(F.lit(2), *keys).alias(j), (F.col(time) if time else F.lit(0)).cast("double").alias(t),
        (F.col(column).cast("double") if keep is None else F.when(keep, F.col(column).cast("double"))).alias(x), (F.coalesce(reset, F.lit(False)) if reset is not None else F.lit(False)).alias(z),
    )
    rows = (rows.repartition(k, j) if keys else rows.repartition(1)).sortWithinPartitions(k, j, order)
    schema = T.StructType([*[f for f in df.schema.fields if f.name != name], T.StructField(name, T.DoubleType())])

    def run(batches):
        nan, last, value = math.nan, None, None
        before = nan
        for b in batches:
            one, two = b.column(k).to_numpy(), b.column(j).to_numpy()
            new = np.ones(len(b), bool)
            new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            if len(b):
                new[0] = last != (one[0], two[0])
                last = one[-1], two[-1]
            out = []
            for start, at, v, anew in zip(new.tolist(), *(pc.fill_null(b.column(c), nan).to_pylist() for c in (t, x)), b.column(z).to_pylist(), strict=True):
                if start:
                    value, before = None, nan
                if how == "decay":
                    value = (0.0 if v != v else v) + (0.0 if anew or value is None else value * math.exp(-rate * (at - before)))
                elif v == v:
                    w = rate if how == "weighted" else math.exp(-rate * (at - before)) if before == before else 0.0
                    value = v if value is None or anew else v * (1 - w) + value * w
                before = at
                out.append(value)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(out, pa.float64())], names=[*kept, name])

    return rows.mapInArrow(run, schema)


def prefix_sum(df: DataFrame, column: str, order: str, bucket: Column, name: str = "cumsum") -> DataFrame:
    """Running sum over a whole table without one task for all: sums inside buckets (a function of the order that grows with it), plus the sums of those before."""
    x = df.withColumn("_b", bucket)
    sums = x.groupBy("_b").agg(F.sum(column).alias("_s"))
    before = sums.select(F.col("_b").alias("_c"), F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum(column).over(Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return x.join(before, F.col("_b").eqNullSafe(F.col("_c"))).withColumn(name, inside + F.col("_before")).select(*df.columns, name)


def half_life(seconds: float) -> float:
    """The decay rate that halves a value in so many time units."""
    return math.log(2) / seconds


__all__: Iterable[str] = ["cumulate", "diff", "differs", "ema", "fill", "find_nth", "half_life", "prefix_sum", "rolling", "rolling_arg", "rolling_quantile", "shift", "time_window"]


def rolling_rank(df: DataFrame, column: str, keys, order, window: int, name: str = "rolling_rank") -> DataFrame:
    """Rank of each value in its frame, scaled from -1 (least) to 1 (greatest), ties by their mean; missing for missing values and frames of one value."""
    w = _over(keys, order).rowsBetween(1 - window, 0)
    held = free(df, "_held")
    c, h = F.col(column), F.col(held)
    below, same, n = F.size(F.filter(h, lambda x: x < c)), F.size(F.filter(h, lambda x: x == c)), F.size(h)
    out = (below + (same - 1) / 2) / F.when(n > 1, n - 1) * 2 - 1
    return df.withColumn(held, F.collect_list(column).over(w)).withColumn(name, F.when(c.isNotNull(), out)).drop(held)
