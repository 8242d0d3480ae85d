"""Grouping: reducing and row-preserving operations on the groups of a table.

An order is given by column names or columns; ordered operations need one. A filter at construction drops rows, and groups
with them; a filter of an operation keeps every group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspan.functions import aggregates as A
from larkspan.operators.select import free

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _list(x) -> list:
    return [x] if isinstance(x, (str, Column)) else list(x)


class Group:
    """df grouped by keys. order: columns that give rows their order. categories: (for one key) values that get a row even if no row has them."""

    def __init__(self, df: DataFrame, keys, order=(), where: Column | None = None, categories: DataFrame | None = None, columns: Iterable[str] | None = None):
        self.df = df if where is None else df.where(where)
        self.keys, self.order, self.categories = _list(keys), _list(order), categories
        self._columns = list(columns) if columns else None

    @property
    def columns(self) -> list[str]:
        """Numeric columns that are not keys, unless columns were given."""
        return self._columns or [f.name for f in self.df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in self.keys]

    def __getitem__(self, columns) -> Group:
        return Group(self.df, self.keys, self.order, None, self.categories, _list(columns))

    # reducing

    def reduce(self, *exprs: Column) -> DataFrame:
        out = self.df.groupBy(*self.keys).agg(*exprs)
        return out if self.categories is None else self.categories.join(out, self.keys, "left")

    def _named(self, name: str, keep: Column | None) -> DataFrame:
        out = self.reduce(*[A.NAMED[name](c, keep).alias(c) for c in self.columns])
        return out.fillna(0, self.columns) if self.categories is not None and name in ("sum", "nansum", "count_uniques") else out

    def count(self, keep: Column | None = None, name: str = "count") -> DataFrame:
        out = self.reduce(A.count(keep).alias(name))
        return out if self.categories is None else out.fillna(0, [name])

    def agg(self, how, keep: Column | None = None) -> DataFrame:
        """A name, a list of names, or a dict column -> names; columns are called column_name."""
        plan = how if isinstance(how, dict) else {c: _list(how) for c in self.columns}
        exprs = []
        for c, names in plan.items():
            for n in _list(names):
                f = A.ORDERED[n](c, F.struct(*self.order), keep) if n in A.ORDERED else A.count(keep) if n == "count" else A.NAMED[n](c, keep)
                exprs.append(f.alias(f"{c}_{n}"))
        return self.reduce(*exprs)

    def first(self) -> DataFrame:
        return self.reduce(*[A.first(c, F.struct(*self.order)).alias(c) for c in self.columns])

    def last(self) -> DataFrame:
        return self.reduce(*[A.last(c, F.struct(*self.order)).alias(c) for c in self.columns])

    def nth(self, n: int) -> DataFrame:
        """The n-th row's values; found by rank, so that no group is collected."""
        w = Window.partitionBy(*self.keys).orderBy(*[c if n >= 0 else F.desc(c) for c in self.order])
        at = F.row_number().over(w) == (n + 1 if n >= 0 else -n)
        return self.df.withColumn("_at", at).groupBy(*self.keys).agg(*[F.max(F.when(F.col("_at"), F.col(c))).alias(c) for c in self.columns])

    def quantile(self, q, strict: bool = False) -> DataFrame:
        """Midpoint quantiles; several get the suffix _q0_25 and so on."""
        qs = q if isinstance(q, (list, tuple)) else [q]
        f = A.quantile if strict else A.nanquantile
        return self.reduce(*[f(c, x).alias(c if len(qs) == 1 else f"{c}_q{str(x).replace('.', '_')}") for c in self.columns for x in qs])

    def keys_only(self) -> DataFrame:
        return self.df.select(*self.keys).distinct()

    def edge(self, last: bool = False) -> DataFrame:
        """The first or last whole row of each group."""
        w = Window.partitionBy(*self.keys).orderBy(*[F.desc(c) if last else c for c in self.order])
        n = free(self.df, "_n")
        return self.df.withColumn(n, F.row_number().over(w)).where(F.col(n) == 1).drop(n)

    def head(self, n: int, last: bool = False) -> DataFrame:
        w = Window.partitionBy(*self.keys).orderBy(*[F.desc(c) if last else c for c in self.order])
        at = free(self.df, "_n")
        return self.df.withColumn(at, F.row_number().over(w)).where(F.col(at) <= n).drop(at)

    def ohlc(self, c: str) -> DataFrame:
        o = F.struct(*self.order)
        return self.reduce(F.min_by(c, o).alias("open"), F.max(c).alias("high"), F.min(c).alias("low"), F.max_by(c, o).alias("close"))

    def describe(self, c: str) -> DataFrame:
        return self.reduce(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), *[F.percentile(c, F.lit(q)).alias(f"p{int(q * 100)}") for q in (0.25, 0.5, 0.75)], F.max(c).alias("max"))

    def totals(self, how: dict[str, str]) -> DataFrame:
        """Reduced values and a row of totals (keys NULL, is_total true), computed from the rows and not from the groups."""
        out = self.df.rollup(*self.keys).agg(*[A.NAMED[n](c).alias(c) for c, n in how.items()], F.grouping_id().alias("_g"))
        return out.where(F.col("_g").isin(0, (1 << len(self.keys)) - 1)).withColumn("is_total", F.col("_g") > 0).drop("_g")

    # access

    def get_group(self, *values) -> DataFrame:
        """The rows of one group; None is the group of missing keys."""
        return self.df.where(reduce(and_, [F.col(k).eqNullSafe(F.lit(v)) for k, v in zip(self.keys, values, strict=True)]))

    def as_filter(self, *values) -> Column:
        """Whether a row is in one of the groups of the first key."""
        return F.coalesce(F.col(self.keys[0]).isin(*values), F.lit(False))

    def iter_groups(self):
        """(keys, rows) of each group in the order of the keys; the keys come to the driver one after the other, rows stay where they are."""
        for row in self.keys_only().orderBy(*self.keys).toLocalIterator():
            yield tuple(row), self.get_group(*row)

    def edge_mask(self, name: str, last: bool = False) -> DataFrame:
        """All rows and whether each is its group's first (last) one."""
        w = Window.partitionBy(*self.keys).orderBy(*[F.desc(c) if last else c for c in self.order])
        return self.df.withColumn(name, F.row_number().over(w) == 1)

    # row-preserving

    @property
    def over(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def transform(self, **exprs: Column) -> DataFrame:
        """Aggregates spread to the rows of their group."""
        w = Window.partitionBy(*self.keys)
        return self.df.withColumns({k: v.over(w) for k, v in exprs.items()})

    def ngroup(self, name: str = "ngroup") -> DataFrame:
        """Groups numbered from 0 in the order of their keys: numbers are made on one row a group and joined back."""
        keys = self.df.select(*self.keys).distinct()
        numbered = keys.withColumn(name, (F.row_number().over(Window.orderBy(*self.keys)) - 1).cast("long"))
        other = numbered.toDF(*[f"_{k}" for k in self.keys], name)
        cond = [self.df[k].eqNullSafe(other[f"_{k}"]) for k in self.keys]
        return self.df.join(other, cond).select(self.df["*"], name)

    def rank(self, c: str, name: str = "rank") -> DataFrame:
        """Average rank."""
        w = Window.partitionBy(*self.keys).orderBy(c)
        peers = F.count(F.lit(1)).over(Window.partitionBy(*self.keys, c))
        return self.df.withColumn(name, F.when(F.col(c).isNotNull(), F.rank().over(w) + (peers - 1) / 2))

    # functions of the user

    def apply(self, f: Callable, schema: str) -> DataFrame:
        """f(pandas frame of a group) -> frame. A group is held by one task: its size must be bounded."""
        return self.df.groupBy(*self.keys).applyInPandas(f, schema)

    def apply_reduce(self, f: Callable, kind: str = "double", transform: bool = False) -> DataFrame:
        """f(series) -> scalar, for each column, by group or spread to the rows."""
        udf = F.pandas_udf(f, kind, F.PandasUDFType.GROUPED_AGG)
        if transform:
            return self.df.withColumns({c: udf(c).over(Window.partitionBy(*self.keys)) for c in self.columns})
        return self.df.groupBy(*self.keys).agg(*[udf(c).alias(c) for c in self.columns])

    def apply_nonreduce(self, f: Callable, name: str, column: str, kind: str = "double") -> DataFrame:
        """f(series of a group in order) -> series as long, as the new column `name`."""
        order = [c for c in self.order if isinstance(c, str)]
        schema = T.StructType([*self.df.schema.fields, T._parse_datatype_string(f"x {kind}").fields[0]])
        schema.fields[-1].name = name
        schema = T.StructType(schema.fields)

        def run(pdf):
            pdf = pdf.sort_values(order)
            return pdf.assign(**{name: f(pdf[column])})

        return self.df.groupBy(*self.keys).applyInPandas(run, schema)


for _name in A.NAMED:
    setattr(Group, _name, lambda self, keep=None, _n=_name: self._named(_n, keep))


def expand_all(df: DataFrame, a: str, b: str) -> DataFrame:
    """Every combination of two keys that occur, from their distinct values."""
    return df.select(a).distinct().crossJoin(df.select(b).distinct())


def unique(df: DataFrame, keys, order=None) -> DataFrame:
    """Distinct keys with their count, and, by order, the first row's order value."""
    keys = _list(keys)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), *([F.min(order).alias("first")] if order else []))


def duplicated(df: DataFrame, keys, order, keep: str | bool = "first", name: str = "duplicated") -> DataFrame:
    """True for rows whose keys another kept row has: keep first, last, or (False) none. Missing keys are equal."""
    keys, order = _list(keys), _list(order)
    if keep is False:
        return df.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1)
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) if keep == "last" else c for c in order])
    return df.withColumn(name, F.row_number().over(w) > 1)


def drop_duplicates(df: DataFrame, keys, order, keep: str | bool = "first") -> DataFrame:
    name = free(df, "_dup")
    return duplicated(df, keys, order, keep, name).where(~F.col(name)).drop(name)


def bincount(df: DataFrame, column: str, bins: int, weight: str | None = None) -> DataFrame:
    """(bin, count) for the bins 0 to bins - 1, empty ones included; values outside and missing ones count nowhere."""
    c = F.col(column)
    found = df.where((c >= 0) & (c < bins)).groupBy(c.cast("long").alias("at")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(found, F.col("bin") == F.col("at"), "left").select("bin", F.coalesce("n", F.lit(0)).alias("count"))
