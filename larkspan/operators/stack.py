"""Stacking tables by rows and columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Numeric types from narrow to wide.
WIDTH = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType()]


def widest(a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b:
        return a
    if a in WIDTH and b in WIDTH:
        # a float can't hold every int or long
        if T.FloatType() in (a, b) and (a in WIDTH[2:4] or b in WIDTH[2:4]):
            return T.DoubleType()
        return max(a, b, key=WIDTH.index)
    return T.StringType()


def concat_rows(*tables: DataFrame, source: str | None = None, names: list[str] | None = None) -> DataFrame:
    """Tables below one another by column name; missing columns are NULL, types widen. source: a column with each table's name."""
    kinds: dict[str, T.DataType] = {}
    for df in tables:
        for f in df.schema.fields:
            kinds[f.name] = widest(kinds[f.name], f.dataType) if f.name in kinds else f.dataType
    out = [df.select(*[F.col(f"`{f.name}`").cast(kinds[f.name]).alias(f.name) for f in df.schema.fields]) for df in tables]
    if source:
        out = [df.withColumn(source, F.lit(n)) for df, n in zip(out, names or map(str, range(len(out))), strict=True)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def concat_columns(tables: list[DataFrame], key: str, on_duplicate: str = "raise") -> DataFrame:
    """Tables beside one another by a shared key (row number or id). Columns of the same name: raise, first or last."""
    out = tables[0]
    for df in tables[1:]:
        clash = [c for c in df.columns if c in out.columns and c != key]
        if clash and on_duplicate == "raise":
            raise ValueError(f"columns {clash} are there twice")
        out = (out.drop(*clash) if on_duplicate == "last" else out).join(df.drop(*clash) if on_duplicate == "first" else df, key, "full_outer")
    return out
