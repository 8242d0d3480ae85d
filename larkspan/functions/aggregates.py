"""Aggregates with the engine's missing-value rules.

Missing is NULL. The plain family gives NULL if any value of a group is missing, the nan family skips missing values. A sum of nothing is 0, every
other aggregate of nothing is NULL. Variances are sample variances. A filter drops values, never groups.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _kept(c: Column, keep: Column | None) -> Column:
    return c if keep is None else F.when(keep, c)


def _strict(c: Column, value: Column, keep: Column | None) -> Column:
    """value, unless one of the rows that are kept is missing."""
    rows = F.count(F.lit(1)) if keep is None else F.count(F.when(keep, 1))
    return F.when(F.count(_kept(c, keep)) == rows, value)


def _family(f: Callable[[Column], Column], empty=None):
    def skipping(c, keep: Column | None = None) -> Column:
        out = f(_kept(_col(c), keep))
        return out if empty is None else F.coalesce(out, F.lit(empty))

    def strict(c, keep: Column | None = None) -> Column:
        return _strict(_col(c), skipping(c, keep), keep)

    return strict, skipping


sum_, nansum = _family(F.sum, 0)
mean, nanmean = _family(F.avg)
min_, nanmin = _family(F.min)
max_, nanmax = _family(F.max)
var, nanvar = _family(F.var_samp)
std, nanstd = _family(F.stddev_samp)
median, nanmedian = _family(F.median)


def count(keep: Column | None = None) -> Column:
    """Rows, missing ones included."""
    return F.count(F.lit(1)) if keep is None else F.count(F.when(keep, 1))


def count_uniques(c, keep: Column | None = None) -> Column:
    return F.count_distinct(_kept(_col(c), keep))


def midpoint(sorted_values: Column, q: float) -> Column:
    """Quantile of a sorted array by the mean of the two values around it."""
    at = (F.size(sorted_values) - 1) * F.lit(float(q))
    low, high = F.get(sorted_values, F.floor(at).cast("int")), F.get(sorted_values, F.ceil(at).cast("int"))
    return F.when(F.size(sorted_values) > 0, F.when(low == high, low.cast("double")).otherwise((low + high) / 2))


def nanquantile(c, q: float, keep: Column | None = None) -> Column:
    """Midpoint quantile of the values that are there. A group's values are held in one list: for groups beyond memory use F.percentile."""
    c = _kept(_col(c), keep)
    return midpoint(F.sort_array(F.collect_list(c)), q)


def quantile(c, q: float, keep: Column | None = None) -> Column:
    return _strict(_col(c), nanquantile(c, q, keep), keep)


def first(c, order, keep: Column | None = None) -> Column:
    """The value in the first row by order, missing or not."""
    order = _kept(_col(order), keep)
    return F.min_by(_col(c), order)


def last(c, order, keep: Column | None = None) -> Column:
    return F.max_by(_col(c), _kept(_col(order), keep))


def nth(c, order, n: int) -> Column:
    """The value of the n-th row by order from 0, or from the end if negative; NULL out of range."""
    rows = F.sort_array(F.collect_list(F.struct(_col(order).alias("o"), _col(c).alias("v"))), asc=n >= 0)
    return F.get(rows, F.lit(n if n >= 0 else -n - 1))["v"]


def mode(c) -> Column:
    """Most frequent value, the smallest of ties."""
    return F.mode(_col(c), True)


def sem(c) -> Column:
    return F.stddev_samp(_col(c)) / F.sqrt(F.count(_col(c)))


def any_(c) -> Column:
    return F.coalesce(F.bool_or(_col(c)), F.lit(False))


def all_(c) -> Column:
    return F.coalesce(F.bool_and(_col(c)), F.lit(True))


def checksum(c) -> Column:
    """The same for the same values in any order."""
    return F.sum(F.xxhash64(_col(c)).cast("decimal(38,0)"))


#: Names for agg(); those in ORDERED need an order.
NAMED: dict[str, Callable] = {
    "sum": sum_, "nansum": nansum, "mean": mean, "nanmean": nanmean, "min": min_, "nanmin": nanmin, "max": max_, "nanmax": nanmax, "var": var, "nanvar": nanvar,
    "std": std, "nanstd": nanstd, "median": median, "nanmedian": nanmedian, "count_uniques": count_uniques, "mode": lambda c, keep=None: mode(_kept(_col(c), keep)), "sem": lambda c, keep=None: sem(_kept(_col(c), keep)),
}
ORDERED: dict[str, Callable] = {"first": first, "last": last}


def register(name: str, f: Callable) -> None:
    """f(column, keep=None) -> aggregate column, for agg() by name."""
    NAMED[name] = f
