"""Rows and columns: filters, masks, samples, trimming, renaming, sorting, comparing."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def take(df: DataFrame, rows: Column | None = None, columns: Iterable[str] | None = None) -> DataFrame:
    df = df if rows is None else df.where(rows)
    return df if columns is None else df.select(*columns)


def between(c: Column, low, high, include_low: bool = True, include_high: bool = False) -> Column:
    return ((c >= low) if include_low else (c > low)) & ((c <= high) if include_high else (c < high))


def put(df: DataFrame, column: str, mask: Column, value) -> DataFrame:
    """value where mask holds; a missing mask does not hold."""
    return df.withColumn(column, F.when(mask, value if isinstance(value, Column) else F.lit(value)).otherwise(F.col(column)))


mask_and = lambda *masks: reduce(and_, masks)
mask_or = lambda *masks: reduce(or_, masks)
mask_xor = lambda *masks: reduce(lambda a, b: a != b, masks)
mask_andnot = lambda first, *masks: reduce(lambda a, b: a & ~b, masks, first)


def row_mask(df: DataFrame, test: Callable[[Column], Column], columns: Iterable[str] | None = None, every: bool = False) -> Column:
    """Whether any (every) column of the row passes the test."""
    return reduce(and_ if every else or_, [F.coalesce(test(F.col(c)), F.lit(False)) for c in columns or numeric(df)])


def nulls_placed(order: Iterable) -> list[Column]:
    """Sort columns with missing values last ascending and first descending. ("a", ("b", False)): b descending."""
    return [F.col(o).asc_nulls_last() if isinstance(o, str) else o if isinstance(o, Column) else F.col(o[0]).asc_nulls_last() if o[1] else F.col(o[0]).desc_nulls_first() for o in order]


def sort(df: DataFrame, *order) -> DataFrame:
    return df.orderBy(*nulls_placed(order))


def head(df: DataFrame, n: int, *order) -> DataFrame:
    return sort(df, *order).limit(n)


def tail(df: DataFrame, n: int, *order) -> DataFrame:
    """The last n rows by names, last one first."""
    return df.orderBy(*[F.col(o).desc_nulls_first() for o in order]).limit(n)


def free(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name in df.columns:
        name += "_"
    return name


def is_sorted(df: DataFrame, column: str, order, ranges: int = 64) -> DataFrame:
    """One row: whether column ascends in order. Rows are dealt to ranges of order and compared inside; then each range's first value with the last one before."""
    x = df.select(F.col(column).alias("v"), F.col(order).alias("o")).repartitionByRange(ranges, "o").withColumn("part", F.spark_partition_id())
    w = Window.partitionBy("part").orderBy("o")
    x = x.select("part", "o", "v", (F.col("v") >= F.lag("v").over(w)).alias("up"))
    x = x.groupBy("part").agg(F.bool_and("up").alias("up"), F.min("o").alias("o"), F.min_by("v", "o").alias("low"), F.max_by("v", "o").alias("high"))
    edge = F.col("low") >= F.lag("high").over(Window.orderBy("o"))  # a row a range
    return x.select("up", edge.alias("edge")).agg((F.coalesce(F.bool_and("up"), F.lit(True)) & F.coalesce(F.bool_and("edge"), F.lit(True))).alias("sorted"))


def sample(df: DataFrame, n: int, seed: int = 0, where: Column | None = None) -> DataFrame:
    """Exactly n random rows (all, if fewer)."""
    df = df if where is None else df.where(where)
    r = free(df, "_r")
    return df.withColumn(r, F.rand(seed)).orderBy(r).limit(n).drop(r)


def hashed_sample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows chosen by a hash of a key: the same rows however the table is stored."""
    return df.orderBy(F.md5(F.concat_ws("/", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def trim(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Without rows whose columns are all zero or missing, and without numeric columns that are so in every row."""
    names = list(columns or numeric(df))
    empty = lambda c: F.coalesce(F.col(c) == 0, F.lit(True))
    dead = df.agg(*[F.bool_and(empty(c)).alias(c) for c in names]).first()
    kept = [c for c in names if not dead[c]]
    return df.drop(*[c for c in names if dead[c]]).where(~reduce(and_, [empty(c) for c in kept], F.lit(True)) if kept else F.lit(False))


def cast(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Values that can't be cast are missing."""
    return df.withColumns({c: F.col(c).try_cast(k) for c, k in kinds.items()})


def columns_like(df: DataFrame, pattern: str | None = None, names: Iterable[str] | None = None) -> list[str]:
    return [c for c in df.columns if (names is None or c in set(names)) and (pattern is None or re.search(pattern, c))]


def keep_columns(df: DataFrame, pattern: str | None = None, names: Iterable[str] | None = None) -> DataFrame:
    return df.select(*columns_like(df, pattern, names))


def drop_columns(df: DataFrame, pattern: str | None = None, names: Iterable[str] | None = None) -> DataFrame:
    return df.drop(*columns_like(df, pattern, names))


def rename(df: DataFrame, how: dict[str, str] | Callable[[str], str]) -> DataFrame:
    f = how if callable(how) else lambda c: how.get(c, c)
    return df.toDF(*[f(c) for c in df.columns])


def add_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return rename(df, lambda c: prefix + c)


def add_suffix(df: DataFrame, suffix: str) -> DataFrame:
    return rename(df, lambda c: c + suffix)


def move(df: DataFrame, names: Iterable[str], to_front: bool = True) -> DataFrame:
    names = list(names)
    rest = [c for c in df.columns if c not in names]
    return df.select(*(names + rest if to_front else rest + names))


def swap(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.withColumns({a: F.col(b), b: F.col(a)})


def map_columns(df: DataFrame, f: Callable[[Column], Column], columns: Iterable[str] | None = None) -> DataFrame:
    return df.withColumns({c: f(F.col(c)) for c in columns or numeric(df)})


def fill_missing(df: DataFrame, value, columns: Iterable[str] | None = None) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(value)) for c in columns or numeric(df)})


def flatten(df: DataFrame, sep: str = "/") -> DataFrame:
    """Struct columns as columns named outer/inner."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StructType):
            out += [F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}{sep}{g.name}") for g in f.dataType.fields]
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def matrix_columns(df: DataFrame, array: str, names: Iterable[str]) -> DataFrame:
    """Elements of an array column as columns."""
    return df.withColumns({n: F.get(array, F.lit(i)) for i, n in enumerate(names)})


def rowwise(df: DataFrame, how: str, columns: Iterable[str] | None = None, name: str | None = None) -> DataFrame:
    """A reduction over columns in each row, missing values skipped: sum, mean, min, max, var, std, count."""
    v = F.filter(F.array(*[F.col(c).cast("double") for c in columns or numeric(df)]), lambda x: x.isNotNull())
    return df.withColumn(name or f"row_{how}", reduce_array(v, how))


def reduce_array(v: Column, how: str) -> Column:
    n = F.size(v)
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    if how == "sum":
        return total
    if how == "count":
        return n.cast("long")
    if how in ("min", "max"):
        return (F.array_min if how == "min" else F.array_max)(v)
    if how == "mean":
        return F.when(n > 0, total / n)
    spread = F.aggregate(v, F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("s")), lambda a, x: F.struct((a["n"] + 1).alias("n"), (a["m"] + (x - a["m"]) / (a["n"] + 1)).alias("m"), (a["s"] + (x - a["m"]) * (x - (a["m"] + (x - a["m"]) / (a["n"] + 1)))).alias("s")), lambda a: F.when(a["n"] > 1, a["s"] / (a["n"] - 1)))
    return spread if how == "var" else F.sqrt(spread)


def arithmetic(left: DataFrame, right, how: str, key: str | None = None) -> DataFrame:
    """Numeric columns of left with those of the same name of right (joined on key, which must not repeat there: an error), or with one value: add, sub, mul, div, mod."""
    op = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: F.try_divide(a.cast("double"), b), "mod": lambda a, b: F.when(b != 0, a % F.when(b != 0, b))}[how]
    if not isinstance(right, DataFrame):
        return left.withColumns({c: op(F.col(c), F.lit(right)) for c in numeric(left) if c != key})
    shared = [c for c in numeric(left) if c in right.columns and c != key]
    at = {c: free(left, f"_{c}") for c in (key, *shared)}
    one = lambda c: F.when(F.count(F.lit(1)) == 1, F.first(c)).otherwise(F.raise_error(F.lit(f"a {key} of the right table is there more than once")))
    r = right.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(at[key])).agg(*[one(c).alias(at[c]) for c in shared])
    x = left.join(r, F.col(key) == F.col(at[key]), "left")
    return x.select(*[op(F.col(c), F.col(at[c])).alias(c) if c in shared else F.col(c) for c in left.columns])


def equals(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """By key, whether each shared column is equal (missing equals missing), and whether both sides have the row."""
    shared = [c for c in left.columns if c in right.columns and c != key]
    l = left.select(F.col(key), *[F.col(c).alias(f"l_{c}") for c in shared], F.lit(True).alias("in_left"))
    r = right.select(F.col(key), *[F.col(c).alias(f"r_{c}") for c in shared], F.lit(True).alias("in_right"))
    return l.join(r, key, "full_outer").select(key, *[F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")).alias(c) for c in shared], (F.col("in_left") & F.col("in_right")).isNotNull().alias("in_both"))


def checksums(df: DataFrame) -> DataFrame:
    """One row: an order-free checksum of each column."""
    return df.agg(*[F.sum(F.xxhash64(c).cast("decimal(38,0)")).alias(c) for c in df.columns])


def outliers(df: DataFrame, key: str, columns: Iterable[str] | None = None) -> DataFrame:
    """(column, low_key, low, high_key, high): where each column is least and greatest; one pass."""
    names = [c for c in columns or numeric(df) if c != key]
    one = df.agg(*[F.struct(F.lit(c).alias("column"), F.min_by(key, F.struct(c, key)).alias("low_key"), F.min(c).cast("double").alias("low"), F.max_by(key, F.struct(c, key)).alias("high_key"), F.max(c).cast("double").alias("high")).alias(c) for c in names])
    return one.select(F.explode(F.array(*names)).alias("x")).select("x.*")


def take_ids(df: DataFrame, ids: DataFrame, key: str, position: str) -> DataFrame:
    """Rows by a table of keys in a wanted order, as often as they are asked for; keys that are not there give missing values."""
    want = ids.select(F.col(key).alias("_want"), F.col(position).alias("_at"))
    x = want.join(df, F.col("_want") == F.col(key), "left")
    return x.withColumn(position, F.col("_at")).drop("_want", "_at")


def vertical(tables: dict[str, DataFrame], source: str = "member") -> DataFrame:
    """Members of a container below one another, named in a column."""
    from larkspan.operators.stack import concat_rows

    return concat_rows(*tables.values(), source=source, names=list(tables))


def horizontal(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Members beside one another by key, columns called member_column."""
    out = None
    for name, df in tables.items():
        df = df.select(F.col(key), *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != key])
        out = df if out is None else out.join(df, key, "full_outer")
    return out


def cascade(tables: dict[str, DataFrame], f: Callable[[DataFrame], DataFrame]) -> dict[str, DataFrame]:
    return {k: f(v) for k, v in tables.items()}


def unflatten(df: DataFrame, sep: str = "/") -> DataFrame:
    """Columns named outer/inner as struct columns again."""
    outer: dict[str, list[str]] = {}
    for c in df.columns:
        outer.setdefault(c.split(sep)[0], []).append(c)
    return df.select(*[F.struct(*[F.col(f"`{c}`").alias(c.split(sep, 1)[1]) for c in cs]).alias(o) if cs != [o] else F.col(f"`{o}`") for o, cs in outer.items()])


def filled_like(df: DataFrame, value, columns: Iterable[str] | None = None) -> DataFrame:
    """As many rows, each column holding one value of its own type."""
    kinds = dict(df.dtypes)
    return df.select(*[F.lit(value).cast(kinds[c]).alias(c) for c in columns or df.columns])


def label_filter(df: DataFrame, labels: Iterable, column: str) -> DataFrame:
    """Rows whose label is one of the labels."""
    return df.where(F.col(column).isin(list(labels)))
