"""Reading and writing tables: Parquet for storage, CSV, Arrow, pandas and Python rows in and out.

A container of tables is a dict of DataFrames, kept as one Parquet folder a member.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ingest(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in float columns and timestamps without zone become UTC timestamps, so that one kind of missing value is left."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.when(~F.isnan(c), c)
        elif isinstance(f.dataType, T.TimestampNTZType):
            c = c.cast("timestamp")
        out.append(c.alias(f.name))
    return df.select(*out)


def load(spark: SparkSession, *paths: str, include: Iterable[str] | None = None, where: Column | None = None, source: str | None = None, clean: bool = True) -> DataFrame:
    """Tables stacked by column name; missing columns are NULL. include and where reach the scan. source names a column for the file's path."""
    df = spark.read.option("mergeSchema", len(paths) > 1).parquet(*paths)
    if source:
        df = df.withColumn(source, F.input_file_name())
    df = ingest(df) if clean else df
    if where is not None:
        df = df.where(where)
    return df.select(*include, *([source] if source else [])) if include else df


def save(df: DataFrame, path: str, mode: str = "overwrite", by: Iterable[str] = (), compression: str = "zstd", block_bytes: int | None = None) -> None:
    """by: partition columns, which later reads prune on."""
    w = df.write.mode(mode).option("compression", compression)
    if block_bytes:
        w = w.option("parquet.block.size", block_bytes)
    w.partitionBy(*by).parquet(path)


def load_between(spark: SparkSession, root: str, column: str, low, high, include: Iterable[str] | None = None) -> DataFrame:
    """The partitions of a partitioned table from low to high; others are not read."""
    df = spark.read.parquet(root).where(F.col(column).between(low, high))
    return df.select(*include) if include else df


def save_all(tables: dict[str, DataFrame], root: str, **how) -> None:
    for name, df in tables.items():
        save(df, f"{root}/{name}", **how)


def load_all(spark: SparkSession, root: str, names: Iterable[str]) -> dict[str, DataFrame]:
    return {n: load(spark, f"{root}/{n}") for n in names}


def concat_files(spark: SparkSession, paths: Iterable[str], output: str, include: Iterable[str] | None = None) -> None:
    save(load(spark, *paths, include=include, clean=False), output)


def info(spark: SparkSession, path: str) -> DataFrame:
    """(column, type, nullable) from the footers alone."""
    return spark.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in spark.read.parquet(path).schema.fields], "column string, type string, nullable boolean")


def load_csv(spark: SparkSession, path: str, names: list[str] | None = None, schema: str | None = None, skip_rows: int = 0, converters: dict[str, Callable[[Column], Column]] | None = None, encoding: str = "UTF-8") -> DataFrame:
    """First line is the header unless names are given; columns are strings unless a schema is. skip_rows lines of each file are left out first."""
    if skip_rows:
        lines = spark.read.text(path, wholetext=True).select(F.explode(F.slice(F.split("value", "\r?\n"), skip_rows + 1, 1 << 30)).alias("value")).where("value <> ''")
        reader = spark.read.option("header", names is None)
        df = (reader.schema(schema) if schema else reader).csv(lines.rdd.map(lambda r: r[0]))
    else:
        reader = spark.read.option("header", names is None).option("encoding", encoding)
        df = (reader.schema(schema) if schema else reader).csv(path)
    if names:
        df = df.toDF(*names)
    for name, f in (converters or {}).items():
        df = df.withColumn(name, f(F.col(name)))
    return df


def from_rows(spark: SparkSession, rows: Iterable, names: list[str] | str) -> DataFrame:
    return spark.createDataFrame(list(rows), names)


def from_tagged_rows(spark: SparkSession, rows: Iterable[dict]) -> DataFrame:
    """Dicts with different keys; missing ones are NULL."""
    rows = list(rows)
    names = list(dict.fromkeys(k for r in rows for k in r))
    return spark.createDataFrame([tuple(r.get(k) for k in names) for r in rows], names)


def jagged(df: DataFrame, column: str, width: int | None = None, base: str = "C", fill=None) -> DataFrame:
    """An array column as `width` columns padded with fill, or, without width, in long form (position, value)."""
    rest = [c for c in df.columns if c != column]
    if width is None:
        return df.select(*rest, F.posexplode(column).alias("position", "value"))
    item = lambda i: F.get(column, F.lit(i)) if fill is None else F.coalesce(F.get(column, F.lit(i)), F.lit(fill))
    return df.select(*rest, *[item(i).alias(f"{base}{i}") for i in range(width)])


def as_struct(df: DataFrame, name: str = "row") -> DataFrame:
    return df.select(F.struct(*df.columns).alias(name))


def as_matrix(df: DataFrame, columns: Iterable[str] | None = None, name: str = "matrix") -> DataFrame:
    """One array of doubles a row."""
    return df.withColumn(name, F.array(*[F.col(c).cast("double") for c in columns or df.columns]))


def append_keyed(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Members stacked by name, with the member's name in `key`."""
    out = None
    for name, df in tables.items():
        df = df.withColumn(key, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def sequence(spark: SparkSession, start: int, stop: int, step: int = 1, name: str = "value") -> DataFrame:
    return spark.range(start, stop, step).withColumnRenamed("id", name)


def tile(df: DataFrame, n: int) -> DataFrame:
    """Rows of df n times over, as one scan."""
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(n)))).drop("_copy")


def from_pandas(spark: SparkSession, frame) -> DataFrame:
    """NaN and NaT become NULL."""
    return ingest(spark.createDataFrame(frame))


def from_arrow(spark: SparkSession, table) -> DataFrame:
    return spark.createDataFrame(table)


def to_arrow(df: DataFrame):
    """The whole table on the driver: for results, not for data."""
    return df.toArrow()


def to_rows(df: DataFrame):
    """Rows as dicts, partition by partition."""
    for r in df.toLocalIterator():
        yield r.asDict(recursive=True)


def read_h5(spark: SparkSession, paths: list[str], dataset: str, schema: str, where: str | None = None) -> DataFrame:
    """HDF5 tables, one file a task, where the h5py package is there on the executors and the paths are on a shared file system."""
    def run(batches):
        import h5py
        import pandas as pd

        for b in batches:
            for p in b["path"]:
                with h5py.File(p, "r") as f:
                    yield pd.DataFrame(f[dataset][:])

    df = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)), "path").mapInPandas(run, schema)
    return ingest(df.where(where) if where else df)
