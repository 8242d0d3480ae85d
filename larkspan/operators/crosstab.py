"""Cross-tabulation, reshaping, binning."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions.math import beside_groups
from larkspan.functions.stats import percentiles

#: Columns of a cross-table at most: their labels are read by the driver.
WIDEST = 10_000
TOTAL = "Total"


def labels(df: DataFrame, column: str) -> list:
    found = [r[0] for r in df.select(column).distinct().orderBy(F.col(column).asc_nulls_last()).limit(WIDEST + 1).collect()]
    if len(found) > WIDEST:
        raise ValueError(f"{column} has over {WIDEST} values; a table that wide is better kept long")
    return found


def cells(df: DataFrame, row: str, column: str, **exprs: Column) -> DataFrame:
    """Aggregates of every cell and every margin, long: row, column, is_row_total, is_column_total. Margins are computed from rows, so medians and means are right."""
    made = df.cube(row, column).agg(*[v.alias(k) for k, v in exprs.items()], F.grouping(row).alias("_r"), F.grouping(column).alias("_c"))
    return made.select(row, column, (F.col("_c") == 1).alias("is_row_total"), (F.col("_r") == 1).alias("is_column_total"), *exprs)


def wide(long: DataFrame, row: str, column: str, value: str, names: Iterable, margins: bool = True, fill=None) -> DataFrame:
    """cells() as a table: a column a label and Total, a last row with is_total."""
    x = long if margins else long.where("not is_row_total and not is_column_total")
    pick = lambda cond: F.max(F.when(cond, F.col(value)))
    put = lambda c: c if fill is None else F.coalesce(c, F.lit(fill))
    out = [put(pick(~F.col("is_row_total") & F.col(column).eqNullSafe(F.lit(n)))).alias(str(n)) for n in names]
    if margins:
        out.append(pick(F.col("is_row_total")).alias(TOTAL))
    x = x.groupBy(row, F.col("is_column_total").alias("is_total")).agg(*out)
    return x if margins else x.drop("is_total")


def crosstab(df: DataFrame, row: str, column: str, agg: Callable[[Column], Column], value: str | None = None, names: Iterable | None = None, margins: bool = True, fill=None) -> DataFrame:
    """Rows by columns with a total row and column. One shuffle of partial aggregates for all cells and margins."""
    expr = agg(F.col(value)) if value else agg(F.lit(1))
    return wide(cells(df, row, column, v=expr), row, column, "v", list(names) if names is not None else labels(df, column), margins, fill)


def ratio(df: DataFrame, row: str, column: str, top: Column, bottom: Column, names: Iterable | None = None) -> DataFrame:
    """top / bottom in every cell and margin; missing where bottom is 0."""
    return wide(cells(df, row, column, v=F.try_divide(top.cast("double"), bottom)), row, column, "v", list(names) if names is not None else labels(df, column))


def percent(df: DataFrame, row: str, column: str, value: Column, by: str = "T", names: Iterable | None = None) -> DataFrame:
    """Percent of the whole (T), of the row's (R) or of the column's (C) margin."""
    c = cells(df, row, column, v=value.cast("double"))
    # cells are few: a margin is found in a window over them
    w = {"T": Window.partitionBy(), "R": Window.partitionBy(row, "is_column_total"), "C": Window.partitionBy(column, "is_row_total")}[by]
    margin = {"T": F.col("is_row_total") & F.col("is_column_total"), "R": F.col("is_row_total"), "C": F.col("is_column_total")}[by]
    c = c.withColumn("v", F.try_divide(100 * F.col("v"), F.max(F.when(margin, F.col("v"))).over(w)))
    return wide(c, row, column, "v", list(names) if names is not None else labels(df, column), fill=0.0)


def side_by_side(df: DataFrame, key: str, **exprs: Column) -> DataFrame:
    """Several aggregates a key, with a row of totals (is_total)."""
    out = df.rollup(key).agg(*[v.alias(k) for k, v in exprs.items()], (F.grouping(key) == 1).alias("is_total"))
    return out


def pivot(df: DataFrame, keys, column: str, values, names: Iterable | None = None) -> DataFrame:
    """Reshape without aggregation: raises if a cell has two rows. Several values give value_label columns."""
    keys, values = [keys] if isinstance(keys, str) else list(keys), [values] if isinstance(values, str) else list(values)
    if df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        raise ValueError("a cell has more than one row")
    names = list(names) if names is not None else labels(df, column)
    at = lambda n, v: F.max(F.when(F.col(column).eqNullSafe(F.lit(n)), F.col(v)))
    return df.groupBy(*keys).agg(*[at(n, v).alias(str(n) if len(values) == 1 else f"{v}_{n}") for v in values for n in names])


def melt(df: DataFrame, ids, values: Iterable[str], variable: str = "variable", value: str = "value", trim: bool = False) -> DataFrame:
    """Wide to long; trim leaves out zeros and missing values."""
    out = df.unpivot([ids] if isinstance(ids, str) else list(ids), list(values), variable, value)
    return out.where(F.coalesce(F.col(value) != 0, F.lit(False))) if trim else out


def transpose(df: DataFrame, key: str) -> DataFrame:
    """Rows to columns, named by key; the table must be small (the driver reads its keys)."""
    return pivot(melt(df, key, [c for c in df.columns if c != key], "column"), "column", key, "value")


def one_hot(df: DataFrame, column: str, names: Iterable | None = None, prefix: str | None = None) -> DataFrame:
    names = list(names) if names is not None else labels(df, column)
    return df.withColumns({f"{prefix or column}_{n}": F.col(column).eqNullSafe(F.lit(n)).cast("int") for n in names})


def bucket(c: Column, edges: list[float], right: bool = True) -> Column:
    """1 for the first bin and so on; 0 outside. right: bins hold their right edge and the first its left edge too; else the left, and the last its right edge."""
    out = F.lit(0)
    for i in reversed(range(len(edges) - 1)):
        a, b = F.lit(float(edges[i])), F.lit(float(edges[i + 1]))
        if right:
            inside = ((c >= a) if i == 0 else (c > a)) & (c <= b)
        else:
            inside = (c >= a) & ((c <= b) if i == len(edges) - 2 else (c < b))
        out = F.when(inside, i + 1).otherwise(out)
    return F.when(c.isNull(), 0).otherwise(out)


def edge_labels(edges: list[float]) -> list[str]:
    return [f"{a}->{b}" for a, b in zip(edges, edges[1:])]  # noqa: B905


def cut(df: DataFrame, column: str, bins, right: bool = True, name: str = "bin", label: str | None = None) -> DataFrame:
    """Equal-width bins (a number: one pass for the range) or explicit edges; code 0 is out of range. label: a column for a->b."""
    if isinstance(bins, int):
        low, high = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
        low, high = low or 0.0, high or 0.0
        edges = [low + (high - low) * i / bins for i in range(bins)] + [high]
    else:
        edges = [float(b) for b in bins]
    out = df.withColumn(name, bucket(F.col(column), edges, right))
    return out if label is None else out.withColumn(label, _label(F.col(name), edge_labels(edges)))


def _label(code: Column, names: list[str]) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, names)), code - 1), F.lit("Filtered"))


def quantile_edges(df: DataFrame, column: str, q) -> list[float]:
    qs = [i / q for i in range(q + 1)] if isinstance(q, int) else list(q)
    return percentiles(df, [column], qs).first()[0] or []


def qcut(df: DataFrame, column: str, q, name: str = "bin", label: str | None = None) -> DataFrame:
    """Bins between quantiles; code 1 is for values outside or missing, bins start at 2."""
    edges = quantile_edges(df, column, q)
    out = df.withColumn(name, bucket(F.col(column), edges) + 1)
    return out if label is None else out.withColumn(label, F.when(F.col(name) == 1, "Clipped").otherwise(_label(F.col(name) - 1, edge_labels(edges))))


def cut_groups(df: DataFrame, column: str, keys, q: int, name: str = "bin") -> DataFrame:
    """qcut inside groups, by edges of each group."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    edges = df.groupBy(*keys).agg(F.percentile(column, F.array(*[F.lit(i / q) for i in range(q + 1)])).alias("_e"))
    c = F.col(column)
    code = F.size(F.filter("_e", lambda e: e < c))
    return beside_groups(df, edges, keys).withColumn(name, F.greatest(code, F.lit(1)) + 1).drop("_e")


def rare(df: DataFrame, column: str, least: int, misc="misc", name: str | None = None) -> DataFrame:
    """Values with fewer rows than `least` become misc."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(F.col(column).alias("_v"))
    x = df.join(counts, F.col(column).eqNullSafe(F.col("_v")), "left")
    return x.withColumn(name or column, F.when(F.col("_v").isNotNull(), F.col("_v")).otherwise(F.lit(misc))).drop("_v")


def compose(tables: dict[str, DataFrame], row: str, margins: Iterable[str], footers: Iterable[str], names: Iterable) -> DataFrame:
    """Several cross-tables as one: the inner table is the first, the Total columns of `margins` stand beside it, the total rows of `footers` below it (kind: the table's name)."""
    inner, *_ = tables
    names = [str(n) for n in names]
    out = tables[inner].where("not is_total").select(row, *names)
    for m in margins:
        side = tables[m].where("not is_total").select(F.col(row).alias("_row"), F.col(TOTAL).alias(m))
        out = out.join(side, F.col(row).eqNullSafe(F.col("_row")), "left").drop("_row")
    out = out.withColumn("kind", F.lit("cells"))
    for f in footers:
        below = tables[f].where("is_total").select(F.lit(None).cast(out.schema[row].dataType).alias(row), *names, F.lit(f).alias("kind"))
        out = out.unionByName(below, allowMissingColumns=True)
    return out


def matrix_apply(df: DataFrame, columns: Iterable[str], f: Callable[[Column], Column]) -> DataFrame:
    """f over the array of each row's columns, back as columns of the same names."""
    names = list(columns)
    x = df.withColumn("_m", f(F.array(*[F.col(c).cast("double") for c in names])))
    return x.withColumns({c: F.get("_m", F.lit(i)) for i, c in enumerate(names)}).drop("_m")
