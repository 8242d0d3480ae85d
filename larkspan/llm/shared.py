"""Helpers shared by the corpus operators: spooling to the shared folder, linking, word sets."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six code points; the character class as Java, DuckDB and Python read it.
WORD = r"[^\x20\x09-\x0D]+"
#: Spark's setting by which a query's shuffle files go when it ends.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def slices(batch, column: str, rows: int = 512, size: int = 1 << 21):
    """Runs of a record batch of at most `rows` rows and about `size` bytes of a text column; a longer text is a run of its own."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(batch):
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))))
        yield batch.slice(at, to - at)
        at = to


def release() -> None:
    """Give freed memory of a Python worker back, so that the next operator's worker finds it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Where it is unset: a local one on a local master, else an error, as executors could not see it."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="larkspan-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def spool(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: the lineage is cut, lost executors lose nothing. by: columns of few values,
    each with a folder of its own, so that a filter on it reads nothing else; then shuffle files of the write go at its end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/larkspan/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if by:
        before = spark.conf.get(TIDY, None)
        spark.conf.set(TIDY, "true")
        try:
            df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
        finally:
            spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)
    else:
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unspool(df: DataFrame) -> None:
    """Delete the table that spool() has read back as df; nothing may read it from then on."""
    spark = df.sparkSession
    for path in {f[: f.index("/", f.index(spark.sparkContext.applicationId) + len(spark.sparkContext.applicationId) + 1)] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns called c0, c1 and so on, and what each is called now: no name of an operator's own columns can clash with one of df."""
    at = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*at.values()), at


def named(x: DataFrame, at: dict[str, str], **added) -> DataFrame:
    """The columns of numbered() under their names, but for those of the same name as one that is added."""
    return x.select(*[F.col(k).alias(c) for c, k in at.items() if c not in added], *[v.alias(c) for c, v in added.items()])


def lower_ascii(c):
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_crc(c):
    """crc32 of an id written as text; null ids hash as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def stars(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components by alternating large and small stars.

    edges: columns a, b (comparable, not null; order, repeats and self-loops are of no matter).
    Returns (a, root): every node that has an edge, with the smallest node it reaches. No edges: an empty table.
    Every round is spooled, groups are reduced before they are dealt out, and only two numbers reach the driver.
    """
    both = lambda e: e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    e = spool(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = mark(e)
    for _ in range(rounds if seen[0] else 0):
        n = both(e)
        low = n.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = n.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        e = spool(small, "edges")
        now = mark(e)
        if now == seen:
            break
        seen = now
    roots = e.groupBy("a").agg(F.min("b").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("a"), "root").distinct())
