"""Numeric and logical expressions. Missing is NULL; NaN and infinities are told apart where a test asks for them."""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def divide(a: Column, b: Column) -> Column:
    """Always a double; missing where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def floor_divide(a: Column, b: Column) -> Column:
    return F.floor(divide(a, b))


def is_missing(c: Column) -> Column:
    return c.isNull() | F.coalesce(F.isnan(c.cast("double")), F.lit(False))


def is_missing_or_zero(c: Column) -> Column:
    return is_missing(c) | (c == 0)


def is_inf(c: Column) -> Column:
    return F.coalesce(F.abs(c.cast("double")) == float("inf"), F.lit(False))


def is_finite(c: Column) -> Column:
    return ~is_missing(c) & ~is_inf(c)


def to_zero(c: Column, infinite: float | None = None) -> Column:
    """Missing values as 0, and infinite ones as a number if one is given."""
    out = F.when(is_missing(c), 0.0).otherwise(c.cast("double"))
    return out if infinite is None else F.when(is_inf(c), F.signum(c) * infinite).otherwise(out)


def clip(c: Column, low=None, high=None) -> Column:
    out = c if low is None else F.when(c.isNotNull(), F.greatest(c, F.lit(low)))
    return out if high is None else F.when(c.isNotNull(), F.least(out, F.lit(high)))


def trunc(c: Column) -> Column:
    return F.signum(c) * F.floor(F.abs(c))


def interpolate(c: Column, xs: list[float], ys: list[float], extrapolate: bool = False) -> Column:
    """Piecewise linear through (xs, ys), xs ascending; outside: the ends' values, or the end pieces' lines."""
    pieces = [F.lit(float(y0)) + (c - float(x0)) * ((y1 - y0) / (x1 - x0)) for x0, x1, y0, y1 in zip(xs, xs[1:], ys, ys[1:])]  # noqa: B905
    out = pieces[-1] if extrapolate else F.when(c >= float(xs[-1]), float(ys[-1])).otherwise(pieces[-1])
    for x1, piece in reversed(list(zip(xs[1:-1], pieces[:-1], strict=True))):
        out = F.when(c < float(x1), piece).otherwise(out)
    if not extrapolate:
        out = F.when(c <= float(xs[0]), float(ys[0])).otherwise(out)
    return F.when(c.isNotNull(), out)


def _beside(df: DataFrame, one: DataFrame) -> DataFrame:
    """A table of one row beside every row; it is broadcast, as its size is one row."""
    return df.crossJoin(F.broadcast(one))


def beside_groups(df: DataFrame, one: DataFrame, keys) -> DataFrame:
    """Each row of df with the row of its group; missing keys are a group, so no row is lost."""
    inner = {k: f"_key{i}" for i, k in enumerate(keys)}
    one = one.withColumnsRenamed(inner)
    cond = [df[k].eqNullSafe(one[n]) for k, n in inner.items()]
    return df.join(one, cond).drop(*inner.values())


def zscore(df: DataFrame, column: str, keys=(), name: str = "zscore") -> DataFrame:
    """(x - mean) / standard deviation, of the table or of the groups."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    one = df.groupBy(*keys).agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"))
    x = beside_groups(df, one, keys) if keys else _beside(df, one)
    return x.withColumn(name, F.try_divide(F.col(column) - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def minmax(df: DataFrame, column: str, name: str = "minmax") -> DataFrame:
    one = df.agg(F.min(column).alias("_a"), F.max(column).alias("_b"))
    return _beside(df, one).withColumn(name, F.try_divide((F.col(column) - F.col("_a")).cast("double"), F.col("_b") - F.col("_a"))).drop("_a", "_b")


def winsorize(df: DataFrame, column: str, low: float, high: float, keys=(), name: str | None = None) -> DataFrame:
    """Values beyond the quantiles low and high become these; of the table or of the groups."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    one = df.groupBy(*keys).agg(F.percentile(column, F.array(F.lit(low), F.lit(high))).alias("_q"))
    x = beside_groups(df, one, keys) if keys else _beside(df, one)
    c = F.col(column)
    return x.withColumn(name or column, F.when(c.isNotNull(), F.least(F.greatest(c, F.get("_q", F.lit(0))), F.get("_q", F.lit(1))))).drop("_q")


def trim_groups(df: DataFrame, column: str, keys, low: float, high: float, name: str | None = None) -> DataFrame:
    """Values beyond their group's quantiles become missing."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    one = df.groupBy(*keys).agg(F.percentile(column, F.array(F.lit(low), F.lit(high))).alias("_q"))
    c = F.col(column)
    return beside_groups(df, one, keys).withColumn(name or column, F.when((c >= F.get("_q", F.lit(0))) & (c <= F.get("_q", F.lit(1))), c)).drop("_q")


# Whole families of scalar functions. Strict: missing if an operand is missing. Results that are not defined (a root of a negative number, a division by 0) are missing.

add, sub, mul = (lambda a, b: a + b), (lambda a, b: a - b), (lambda a, b: a * b)
square = lambda c: c * c
cbrt, exp, expm1 = F.cbrt, F.exp, F.expm1
exp2 = lambda c: F.pow(F.lit(2.0), c)
reciprocal = lambda c: divide(F.lit(1.0), c)
sign, floor, ceil, rint, negative, absolute = F.signum, F.floor, F.ceil, F.rint, F.negative, F.abs


def mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of b; missing where b is 0."""
    return F.when(b != 0, F.pmod(F.pmod(a, F.when(b != 0, b)) + F.when(b != 0, b), F.when(b != 0, b)))


def fmod(a: Column, b: Column) -> Column:
    """Remainder with the sign of a; missing where b is 0."""
    return F.try_mod(a, b)


def power(a: Column, b) -> Column:
    return F.pow(a, b)


def sqrt(c: Column) -> Column:
    return F.when(c >= 0, F.sqrt(c))


def log(c: Column, base: float | None = None) -> Column:
    """Natural, or to base 2, 10 or any other; missing for 0 and below."""
    out = {None: F.ln, 2: F.log2, 10: F.log10}.get(base)
    return F.when(c > 0, out(c) if out else F.ln(c) / math.log(base))


def log1p(c: Column) -> Column:
    return F.when(c > -1, F.log1p(c))


def minimum(*columns: Column) -> Column:
    """Least of the columns, missing if one is."""
    return F.when(~reduce(or_, [c.isNull() for c in columns]), F.least(*columns))


def maximum(*columns: Column) -> Column:
    return F.when(~reduce(or_, [c.isNull() for c in columns]), F.greatest(*columns))


#: Least and greatest of the columns that are there.
fmin, fmax = F.least, F.greatest

#: Comparisons in which a missing side gives False (not equal: True).
COMPARE = {
    "eq": lambda a, b: F.coalesce(a == b, F.lit(False)), "ne": lambda a, b: F.coalesce(a != b, F.lit(True)), "lt": lambda a, b: F.coalesce(a < b, F.lit(False)),
    "le": lambda a, b: F.coalesce(a <= b, F.lit(False)), "gt": lambda a, b: F.coalesce(a > b, F.lit(False)), "ge": lambda a, b: F.coalesce(a >= b, F.lit(False)),
}
#: Bits of whole numbers; a missing operand gives a missing result.
BITS = {
    "and": lambda a, b: a.bitwiseAND(b), "or": lambda a, b: a.bitwiseOR(b), "xor": lambda a, b: a.bitwiseXOR(b), "andnot": lambda a, b: a.bitwiseAND(F.bitwise_not(b)), "notand": lambda a, b: F.bitwise_not(a).bitwiseAND(b),
    "shift_left": lambda a, n: F.shiftleft(a, n), "shift_right": lambda a, n: F.shiftright(a, n), "not": lambda a: F.bitwise_not(a),
}


def logical(a: Column, b: Column, how: str) -> Column:
    """and, or, xor of truth values; missing is False."""
    a, b = F.coalesce(a.cast("boolean"), F.lit(False)), F.coalesce(b.cast("boolean"), F.lit(False))
    return {"and": a & b, "or": a | b, "xor": a != b}[how]
