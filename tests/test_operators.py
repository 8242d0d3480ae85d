"""Rules of the operators on small tables: missing values, ties, filters, errors."""

import pytest
from pyspark.sql import functions as F

from larkspan.functions import aggregates as A
from larkspan.functions import math as M
from larkspan.functions import temporal as D
from larkspan.operators import crosstab, joins, select, stack, window
from larkspan.operators.group import Group, duplicated
from larkspan.sources import tables


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_left_join_missing_keys(spark):
    left = spark.createDataFrame([(1.0, 5), (None, 6), (2.0, 7)], "k double, a int")
    right = tables.ingest(spark.createDataFrame([(float("nan"), 1), (1.0, 2), (2.0, 3)], "k double, b int"))
    assert rows(joins.merge(left, right, "k"), "a") == [(1.0, 5, 2), (None, 6, None), (2.0, 7, 3)]


def test_join_errors(spark):
    a, b = spark.createDataFrame([(1, 2), (1, 3)], "k int, x int"), spark.createDataFrame([(1, 2)], "k int, x int")
    with pytest.raises(ValueError, match="suffixes"):
        joins.merge(a, b, "k")
    with pytest.raises(ValueError, match="unique"):
        joins.merge(b, a, "k", suffixes=("", "_r"), validate="1:1")
    with pytest.raises(ValueError, match="unique"):
        joins.lookup(b, a, "k", suffix="_r")
    with pytest.raises(ValueError, match="outer"):
        joins.merge(a, b, "k", "outer", keep=("first", None), order=("x", None), suffixes=("", "_r"))
    with pytest.raises(ValueError, match="no match"):
        joins.lookup(spark.createDataFrame([(9,)], "k int"), b, "k", require_match=True)


def test_empty_strings_match(spark):
    a, b = spark.createDataFrame([("", 1)], "k string, x int"), spark.createDataFrame([("", 2)], "k string, y int")
    assert rows(joins.merge(a, b, "k", "inner")) == [("", 1, 2)]


def brute_asof(left, right, direction, exact=True, tolerance=None):
    """For each time of left the value of the nearest row of right (time, value) on the allowed side; of equal times the greatest value, of equally near ones the earlier."""
    out = []
    for t in left:
        there = [(abs(t - u), u, -v, v) for u, v in right if (direction != "backward" or u <= t) and (direction != "forward" or u >= t) and (exact or u != t) and (tolerance is None or abs(t - u) <= tolerance)]
        out.append(min(there)[3] if there else None)
    return out


RIGHT = [(2, 11), (4, 13), (4, 12), (9, 17), (13, 14), (13, 19), (21, 10)]


@pytest.mark.parametrize("direction, exact, tolerance", [("backward", True, None), ("backward", False, None), ("forward", True, None), ("nearest", True, None), ("backward", True, 2), ("forward", False, 3)])
def test_asof(spark, direction, exact, tolerance):
    times = [1, 2, 3, 4, 8, 11, 13, 14, 17, 25]
    left = spark.createDataFrame([(t,) for t in times], "t int")
    right = spark.createDataFrame(RIGHT if direction != "forward" else [(t, -v) for t, v in RIGHT], "t int, v int")
    got = [r[1] for r in rows(joins.asof(left, right, "t", direction=direction, exact=exact, tolerance=tolerance, order_right="v"), "t")]
    one = {}
    for t, v in [tuple(r) for r in right.collect()]:  # of equal times the last by order (the first, looking forward)
        one[t] = v if t not in one else (min if direction == "forward" else max)(one[t], v)
    assert got == brute_asof(times, list(one.items()), direction, exact, tolerance)


def test_strict_and_skipping(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("c", None)], "k string, x double")
    got = rows(Group(df, "k").reduce(A.sum_("x").alias("s"), A.nansum("x").alias("n"), A.nanmean("x").alias("m"), A.nanvar("x").alias("v"), A.count().alias("c")), "k")
    assert got == [("a", None, 1.0, 1.0, None, 2), ("b", 2.0, 2.0, 2.0, None, 1), ("c", None, 0.0, None, None, 1)]


def test_filter_keeps_groups(spark):
    df = spark.createDataFrame([("x", 1), ("y", 4), ("x", 2), ("y", 4), ("z", 9)], "k string, x int")
    assert rows(Group(df, "k").reduce(A.count_uniques("x", F.col("x") > 3).alias("n")), "k") == [("x", 0), ("y", 1), ("z", 1)]


def test_midpoint_quantile(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (8.0,)], "x double")
    assert df.agg(A.nanquantile("x", 0.3)).first()[0] == 1.5


def test_nth_and_mode(spark):
    df = spark.createDataFrame([("a", i, i * 10) for i in range(3)], "k string, o int, x int")
    g = Group(df, "k", "o")["x"]
    assert [g.nth(n).first()["x"] for n in (0, 2, -1, -3, 3)] == [0, 20, 20, 0, None]
    assert spark.createDataFrame([(2,), (1,), (2,), (1,)], "x int").agg(A.mode("x")).first()[0] == 1


def test_empty_categories(spark):
    df = spark.createDataFrame([("a", 1)], "k string, x int")
    got = Group(df, "k", categories=spark.createDataFrame([("a",), ("z",)], "k string"))
    assert rows(got.count(), "k") == [("a", 1), ("z", 0)]
    assert rows(got.nansum(), "k") == [("a", 1), ("z", 0)]


def test_duplicates(spark):
    pairs = [(3, "p"), (None, "p"), (3, None), (3, "p"), (None, "p"), (7, None), (3, None)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "r int, a int, b string")
    assert [r[0] for r in rows(duplicated(df, ["a", "b"], "r").where("duplicated"), "r")] == [i for i, p in enumerate(pairs) if p in pairs[:i]]
    assert [r[0] for r in rows(duplicated(df, ["a", "b"], "r", False).where("duplicated"), "r")] == [i for i, p in enumerate(pairs) if pairs.count(p) > 1]


def seq(spark, xs, kind="double"):
    return spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"i int, x {kind}")


def values(df, c):
    return [r[c] for r in df.orderBy("i").collect()]


XS = [4.0, None, 2.5, 1.0, None, None, None, 8.0, 3.0]


def test_rolling_missing(spark):
    want = [sum(x for x in XS[max(0, i - 2) : i + 1] if x is not None) for i in range(len(XS))]
    assert values(window.rolling(seq(spark, XS), "x", "sum", (), "i"), "rolling_sum") == want


def test_time_window(spark):
    times = [0, 2, 3, 7, 8, 15, 16, 18]
    df = spark.createDataFrame([(t, float(t * t)) for t in times], "i int, x double")
    assert values(window.time_window(df, "x", (), "i", 6), "window") == [sum(u * u for u in times if t - 6 <= u <= t) for t in times]


def test_ema(spark):
    given = [(i, i % 2, float(7 * i % 5)) for i in range(8)]
    want, last = [], {}
    for _, g, x in given:
        last[g] = x if g not in last else 0.75 * x + 0.25 * last[g]
        want.append(last[g])
    df = spark.createDataFrame(given, "i int, g int, x double")
    assert values(window.ema(df, "x", "g", "i", 0.25, "weighted"), "ema") == pytest.approx(want)
    got = values(window.ema(seq(spark, [1.0, None, 2.0]), "x", (), "i", 0.0, "decay", time="i"), "ema")
    assert got == [1, 1, 3]


def test_shift_filter(spark):
    keep = [True, False, True, True, True, False, False, True]
    want, last = [], {}
    for i, k in enumerate(keep):
        want.append(last.get(i % 2) if k else None)
        if k:
            last[i % 2] = float(i)
    df = spark.createDataFrame([(i, "pq"[i % 2], float(i), k) for i, k in enumerate(keep)], "i int, g string, x double, f boolean")
    assert values(window.shift(df, "x", "g", "i", keep=F.col("f")), "shifted") == want


def test_fill(spark):
    given = [("u", 5), ("v", None), ("u", None), ("v", 2), ("v", None), ("u", None), ("u", 1)]
    want, last = [], {}
    for k, x in given:
        last[k] = last.get(k) if x is None else x
        want.append(last[k])
    df = spark.createDataFrame([(i, *g) for i, g in enumerate(given)], "i int, k string, x int")
    assert values(window.fill(df, "x", "k", "i"), "x") == want
    assert values(window.fill(seq(spark, [None, 1.0, None, None]), "x", (), "i", limit=1, value=9.0), "x") == [9, 1, 1, None]


def test_cut(spark):
    xs = [0.0, 2.0, 2.5, 4.0, 7.9, 8.0, 12.0]
    assert values(crosstab.cut(seq(spark, xs), "x", 3), "bin") == [1 if x <= 4 else 2 if x <= 8 else 3 for x in xs]
    xs = [2.0, 8.0, 4.5, 4.0, 7.0, None, 11.0]
    df, edges = seq(spark, xs), [2, 4, 8]
    assert values(crosstab.cut(df, "x", edges, label="l"), "l") == ["2.0->4.0", "4.0->8.0", "4.0->8.0", "2.0->4.0", "4.0->8.0", "Filtered", "Filtered"]
    assert values(crosstab.cut(df, "x", edges, right=False), "bin") == [1, 2, 2, 2, 2, 0, 0]
    assert values(crosstab.qcut(seq(spark, [10.0, 20.0, 30.0, 40.0, 50.0, 60.0]), "x", 2), "bin") == [2, 2, 2, 3, 3, 3]


def test_percent(spark):
    cells = {("r1", "c1"): 3.0, ("r1", "c2"): 1.0, ("r2", "c1"): 1.0, ("r2", "c2"): 5.0}
    df = spark.createDataFrame([(r, c, n / 2) for (r, c), n in cells.items() for _ in range(2)], "s string, e string, n double")
    total = {r: sum(n for (x, _), n in cells.items() if x == r) for r in ("r1", "r2")}, {c: sum(n for (_, x), n in cells.items() if x == c) for c in ("c1", "c2")}
    got = {r["s"]: r for r in crosstab.percent(df, "s", "e", F.sum("n"), names=["c1", "c2"]).collect()}
    assert all(got[r][c] == 100 * n / 10 for (r, c), n in cells.items()) and got["r1"]["Total"] == 10 * total[0]["r1"]
    got = {r["s"]: r for r in crosstab.percent(df, "s", "e", F.sum("n"), "C", ["c1", "c2"]).collect()}
    assert all(got[r][c] == pytest.approx(100 * n / total[1][c]) for (r, c), n in cells.items())


def test_missing_keys_and_names(spark):
    """No row is lost to a missing key, no column to an inner name, and a key that repeats is an error."""
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 2), (None, 5.0, 3), (None, 9.0, 4)], "k string, x double, _n int").withColumn("_dup", F.lit(1)).withColumn("_r", F.lit(2))
    for made in (M.zscore(df, "x", "k"), M.winsorize(df, "x", 0.0, 1.0, "k"), M.trim_groups(df, "x", "k", 0.0, 1.0), crosstab.cut_groups(df, "x", "k", 2)):
        assert made.count() == 4
    assert Group(df, "k", "x").head(1).columns == df.columns and Group(df, "k", "x").edge().columns == df.columns
    assert select.sample(df, 2).columns == df.columns
    from larkspan.operators.group import drop_duplicates

    assert drop_duplicates(df, "k", "x").columns == df.columns and drop_duplicates(df, "k", "x").count() == 2
    twice = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "k string, x double")
    with pytest.raises(Exception, match="more than once"):
        select.arithmetic(df, twice, "add", "k").collect()


def test_sorted_by_ranges(spark):
    up = spark.range(3000).select(F.col("id").alias("o"), (F.col("id") / 7).alias("x"))
    assert select.is_sorted(up, "x", "o").first()[0] and select.is_sorted(up.where("false"), "x", "o").first()[0]
    for at in (1, 1500, 2999):
        assert not select.is_sorted(up.withColumn("x", F.when(F.col("o") == at, -1.0).otherwise(F.col("x"))), "x", "o").first()[0]


def test_pivot_raises(spark):
    df = spark.createDataFrame([(1, "a", 2), (1, "a", 3)], "k int, c string, v int")
    with pytest.raises(ValueError):
        crosstab.pivot(df, "k", "c", "v")


def test_stack(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(1.5,)], "x double")
    got = stack.concat_rows(a, b)
    assert dict(got.dtypes) == {"x": "double", "y": "int"} and rows(got, "x") == [(1.0, 2), (1.5, None)]
    with pytest.raises(ValueError):
        stack.concat_columns([a, a], "x")


def test_rowwise_and_trim(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (None, None, None), (0.0, None, 0.0)], "a double, b double, c double")
    assert [r["row_sum"] for r in select.rowwise(df, "sum").collect()] == [4, 0, 0]
    assert [r["row_var"] for r in select.rowwise(df, "var").collect()] == [2, None, 0]
    assert rows(select.trim(df)) == [(1.0, 3.0)]


def test_interpolate_and_clip(spark):
    df = seq(spark, [-1.0, 0.0, 5.0, 15.0, 30.0, None])
    assert values(df.withColumn("y", M.interpolate(F.col("x"), [0, 10, 20], [0, 1, 3])), "y") == [0, 0, 0.5, 2, 3, None]
    assert values(df.withColumn("y", M.interpolate(F.col("x"), [0, 10, 20], [0, 1, 3], True)), "y") == [-0.1, 0, 0.5, 2, 5, None]
    assert values(df.withColumn("y", M.clip(F.col("x"), 0, 10)), "y") == [0, 0, 5, 10, 10, None]


def test_dst(spark):
    df = spark.sql("select timestamp '2024-01-15 12:00:00' t union all select timestamp '2024-07-15 12:00:00'")
    assert [tuple(r) for r in df.orderBy("t").select(D.is_dst(F.col("t"), "America/New_York"), D.offset(F.col("t"), "America/New_York")).collect()] == [(False, -5.0), (True, -4.0)]


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "b", float("nan"))], "p int, s string, x double")
    tables.save(df, f"{tmp_path}/t", by=["p"])
    assert rows(tables.load_between(spark, f"{tmp_path}/t", "p", 2, 3, ["s"])) == [("b",)]
    assert rows(tables.load(spark, f"{tmp_path}/t", include=["s", "x"]), "s") == [("a", 2.0), ("b", None)]
    assert tables.info(spark, f"{tmp_path}/t").count() == 3
    (tmp_path / "c.csv").write_text("skip\na,b\n1,2\n")
    assert rows(tables.load_csv(spark, f"{tmp_path}/c.csv", skip_rows=1, converters={"a": lambda c: c.cast("int")})) == [(1, "2")]
    assert rows(tables.from_tagged_rows(spark, [{"a": 1}, {"a": 2, "b": 3}]), "a") == [(1, None), (2, 3)]


def test_streaming(spark, data, tmp_path):
    from larkspan.streaming import twins

    schema = spark.read.parquet(f"{data}/events.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{data}/events.parquet").write.parquet(f"{tmp_path}/in/a")
    s = twins.read(spark, f"{tmp_path}/in/a", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    got = twins.run_to_table(twins.windowed(s, "ts", "1 day", "0 seconds", "event_type", n=F.count(F.lit(1))), "days", f"{tmp_path}/cp", "complete")
    want = spark.read.parquet(f"{data}/events.parquet").count()
    assert got.agg(F.sum("n")).first()[0] == want
