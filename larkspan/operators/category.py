"""Dictionary-encoded keys: a key column with a dimension table of codes and labels.

Code 0 is Filtered: rows that are left out of the grouping but not of the table. Codes of labels start at 1, in the order of the labels.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERED = "Filtered"


def dimension(df: DataFrame, keys, base: int = 1) -> DataFrame:
    """(code, keys): the distinct keys, numbered in their order; missing ones have no code. One row a key, so one task numbers them."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.dropna(subset=keys).select(*keys).distinct().select((F.row_number().over(Window.orderBy(*keys)) + (base - 1)).cast("long").alias("code"), *keys)


def declared(df: DataFrame, labels: Iterable, name: str, base: int = 1) -> DataFrame:
    """A dimension of given labels, in their order."""
    return df.sparkSession.createDataFrame([(i + base, x) for i, x in enumerate(labels)], ["code", name])


def encode(df: DataFrame, keys, dim: DataFrame | None = None, where: Column | None = None, name: str = "code") -> DataFrame:
    """df with its key's code; 0 for missing or unknown keys and for rows that where leaves out."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    dim = dimension(df, keys) if dim is None else dim
    d = dim.select(F.col("code").alias("_code"), *[F.col(k).alias(f"_{k}") for k in keys])
    x = df.join(d, [F.col(k) == F.col(f"_{k}") for k in keys], "left")
    code = F.coalesce("_code", F.lit(0))
    return x.select(*df.columns, (code if where is None else F.when(where, code).otherwise(0)).cast("long").alias(name))


def decode(df: DataFrame, dim: DataFrame, code: str = "code", missing: str | None = FILTERED) -> DataFrame:
    """Codes back to labels (several keys as one text joined by _); code 0 and unknown codes become `missing`."""
    keys = [c for c in dim.columns if c != "code"]
    label = F.col(keys[0]) if len(keys) == 1 else F.concat_ws("_", *keys)
    d = dim.select(F.col("code").alias("_code"), label.alias("_label"))
    x = df.join(d, F.col(code) == F.col("_code"), "left")
    return x.select(*df.columns, (F.col("_label") if missing is None else F.coalesce(F.col("_label").cast("string"), F.lit(missing))).alias("label"))


def shown(key: Column, where: Column) -> Column:
    """The key, or Filtered for rows that where leaves out: for groupings that show these."""
    return F.when(where, key.cast("string")).otherwise(F.lit(FILTERED))


def shrink(dim: DataFrame, used: DataFrame, code: str = "code") -> DataFrame:
    """Only labels whose code occurs, numbered anew."""
    keys = [c for c in dim.columns if c != "code"]
    left = dim.join(used.select(F.col(code).alias("_c")).distinct(), F.col("code") == F.col("_c"), "left_semi")
    return left.select(F.row_number().over(Window.orderBy("code")).cast("long").alias("code"), *keys)


def align(*dims: DataFrame) -> DataFrame:
    """One dimension for several: the union of their labels, numbered in order."""
    keys = [c for c in dims[0].columns if c != "code"]
    out = dims[0].select(*keys)
    for d in dims[1:]:
        out = out.unionByName(d.select(*keys))
    return dimension(out, keys)


def add(dim: DataFrame, labels: Iterable) -> DataFrame:
    """Labels appended, with the next codes."""
    key = next(c for c in dim.columns if c != "code")
    labels = list(labels)
    top = dim.agg(F.coalesce(F.max("code"), F.lit(0))).first()[0]
    return dim.unionByName(dim.sparkSession.createDataFrame([(top + 1 + i, x) for i, x in enumerate(labels)], dim.select("code", key).schema))


def remove(dim: DataFrame, labels: Iterable) -> DataFrame:
    """Without labels; their rows decode as Filtered."""
    key = next(c for c in dim.columns if c != "code")
    return dim.where(~F.col(key).isin(list(labels)))


def replace(dim: DataFrame, how: dict) -> DataFrame:
    """Labels renamed."""
    key = next(c for c in dim.columns if c != "code")
    pairs = F.create_map(*[F.lit(x) for kv in how.items() for x in kv])
    return dim.withColumn(key, F.coalesce(F.try_element_at(pairs, F.col(key)), F.col(key)))


def mapped(df: DataFrame, code: str, mapping: dict, invalid: str = "!<{}>", name: str = "label") -> DataFrame:
    """Enum codes to their names; unknown codes as !<code>."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    a, b = invalid.split("{}")
    return df.withColumn(name, F.coalesce(F.try_element_at(pairs, F.col(code)), F.concat(F.lit(a), F.col(code).cast("string"), F.lit(b))))
