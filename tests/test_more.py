"""User functions, categories, selection and sources on small tables."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from larkspan.functions import aggregates as A
from larkspan.functions import math as M
from larkspan.functions import stats
from larkspan.functions import strings as S
from larkspan.functions import temporal as D
from larkspan.operators import category, crosstab, joins, select, window
from larkspan.operators.group import Group, expand_all, unique
from larkspan.sources import tables


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), ("b", 3, 5.0), ("b", 4, None)], "k string, i int, x double").cache()


def test_user_functions(df):
    g = Group(df, "k", "i")
    assert rows(g.apply_nonreduce(lambda s: s.cumsum(), "c", "x").select("i", "c"), "i") == [(1, 1.0), (2, 4.0), (3, 5.0), (4, None)]
    assert rows(g["x"].apply_reduce(lambda s: float(s.sum())), "k") == [("a", 4.0), ("b", 5.0)]
    assert rows(g["x"].apply_reduce(lambda s: float(s.sum()), transform=True).select("i", "x"), "i") == [(1, 4.0), (2, 4.0), (3, 5.0), (4, 5.0)]
    A.register("spread", lambda c, keep=None: F.max(c) - F.min(c))
    assert rows(g.agg({"x": "spread"}), "k") == [("a", 2.0), ("b", 0.0)]


def test_group_more(df):
    g = Group(df, "k", "i")
    assert rows(g.edge(last=True).select("k", "i"), "k") == [("a", 2), ("b", 4)]
    assert rows(g["x"].last(), "k") == [("a", 3.0), ("b", None)]
    assert rows(g["x"].median(), "k") == [("a", 2.0), ("b", None)]
    assert rows(g["x"].nanmedian(), "k") == [("a", 2.0), ("b", 5.0)]
    assert rows(g.keys_only(), "k") == [("a",), ("b",)]
    assert g.describe("x").count() == 2 and expand_all(df, "k", "i").count() == 8
    assert rows(unique(df, "k"), "k") == [("a", 2), ("b", 2)]


def test_category(df):
    dim = category.dimension(df, "k")
    assert rows(dim, "code") == [(1, "a"), (2, "b")]
    coded = category.encode(df, "k", dim, F.col("i") > 1)
    assert [r["code"] for r in coded.orderBy("i").collect()] == [0, 1, 2, 2]
    assert [r["label"] for r in category.decode(coded, dim).orderBy("i").collect()] == ["Filtered", "a", "b", "b"]
    assert rows(category.add(dim, ["z"]), "code")[-1] == (3, "z")
    assert rows(category.remove(dim, ["a"])) == [(2, "b")]
    assert rows(category.replace(dim, {"a": "A"}), "code") == [(1, "A"), (2, "b")]
    assert rows(category.align(dim, category.declared(df, ["c", "b"], "k")), "code") == [(1, "a"), (2, "b"), (3, "c")]
    assert rows(category.shrink(dim, coded.where("k = 'b'"))) == [(1, "b")]


def test_select_more(spark, df):
    assert select.rename(df, {"x": "y"}).columns == ["k", "i", "y"] and select.keep_columns(df, "^[kx]$").columns == ["k", "x"] and select.drop_columns(df, names=["i"]).columns == ["k", "x"]
    assert select.add_prefix(df, "p_").columns == ["p_k", "p_i", "p_x"] and select.move(df, ["k"], False).columns == ["i", "x", "k"]
    assert select.sample(df, 2, 1).count() == 2 and select.fill_missing(df, 0.0, ["x"]).agg(F.sum("x")).first()[0] == 9
    assert select.flatten(df.select(F.struct("k", "i").alias("s"), "x")).columns == ["s/k", "s/i", "x"]
    assert rows(select.cast(spark.createDataFrame([("1",), ("z",)], "s string"), {"s": "int"})) == [(1,), (None,)]
    assert select.checksums(df).first() == select.checksums(df.repartition(3)).first()
    assert df.where(select.row_mask(df, lambda c: c.isNull(), ["i", "x"])).count() == 1
    assert df.where(select.mask_andnot(F.col("i") > 1, F.col("k") == "b")).count() == 1
    assert rows(select.map_columns(df, lambda c: c * 2, ["i"]).select("i"), "i") == [(2,), (4,), (6,), (8,)]


def test_windows_more(df):
    assert [r["shifted"] for r in window.shift(df, "x", (), "i", -1).orderBy("i").collect()] == [3.0, 5.0, None, None]
    assert [r["c"] for r in window.prefix_sum(df, "i", "i", F.floor(F.col("i") / 2), "c").orderBy("i").collect()] == [1, 3, 6, 10]
    assert [r["same"] for r in window.differs(df, "k", (), "i", "same", same=True).orderBy("i").collect()] == [False, True, False, True]
    assert [r["cumsum"] for r in window.cumulate(df, "i", "sum", (), "i", keep=F.col("i") != 2).orderBy("i").collect()] == [1, 1, 4, 8]


def test_functions_more(spark, df):
    one = spark.createDataFrame([("hello world", 7.5, float("nan"))], "s string, x double, n double")
    got = one.select(S.index(F.col("s"), "wor"), S.index(F.col("s"), "q"), S.index_any_of(F.col("s"), "ow"), S.char(F.col("s"), -1), S.substr(F.col("s"), -5, -1), S.strip_trailing(F.col("s"), "d"), S.substr_char_stop(F.col("s"), " ")).first()
    assert tuple(got) == (6, -1, 4, "d", "worl", "hello worl", "hello")
    assert tuple(one.select(M.trunc(-F.col("x")), M.is_missing(F.col("n")), M.is_finite(F.col("x")), M.floor_divide(F.col("x"), F.lit(2)), M.divide(F.col("x"), F.lit(0)), M.to_zero(F.col("n"))).first()) == (-7.0, True, True, 3, None, 0.0)
    t = spark.sql("select timestamp '2024-03-01 09:45:30.5' t").select(D.fraction(F.col("t"), "hour"), D.fraction(F.col("t"), "second"), D.part(F.col("t"), "yyyymmdd"), D.strftime(D.shift(F.col("t"), D.span(1, "hour")), "%H:%M"), D.in_units(D.since_midnight(F.col("t")), "hour")).first()
    assert t[0] == pytest.approx(9 + 45.5083333 / 60, abs=1e-5) and t[1] == 30.5 and t[2] == 20240301 and t[3] == "10:45" and t[4] == pytest.approx(t[0])
    assert spark.range(1).select(D.strftime(D.from_day_number(F.lit(719529.5)), "%Y-%m-%d %H")).first()[0] == "1970-01-01 12"
    assert rows(stats.polynomial(spark.range(6).select((F.col("id") * F.col("id") * 2 + 1.0).alias("y"), F.col("id").alias("x")), "y", "x", 2).select(F.round("weight", 6))) == [(2.0,), (0.0,), (1.0,)]
    assert stats.statx(df, "x").first()["count"] == 4 and rows(stats.arg_extreme(df, "x", "i", True)) == [(3,)]


def test_crosstab_more(df):
    assert rows(crosstab.transpose(df.select("k", "i").groupBy("k").agg(F.sum("i").alias("s")), "k")) == [("s", 3, 7)]
    assert [r["k"] for r in crosstab.rare(df.unionByName(df.limit(1).withColumn("k", F.lit("q"))), "k", 2).where("k = 'misc'").collect()] == ["misc"]
    assert rows(crosstab.melt(df, ["k", "i"], ["x"], trim=True).select("i"), "i") == [(1,), (2,), (3,)]
    assert crosstab.edge_labels([1.0, 2.0, 3.0]) == ["1.0->2.0", "2.0->3.0"]


def test_sources_more(spark, tmp_path):
    made = tables.from_pandas(spark, pd.DataFrame({"a": [1.0, float("nan")], "b": ["x", "y"]}))
    assert rows(made, "b") == [(1.0, "x"), (None, "y")]
    assert tables.from_arrow(spark, tables.to_arrow(made)).count() == 2 and [r["b"] for r in tables.to_rows(made)] == ["x", "y"]
    tables.save_all({"m": made, "n": made}, f"{tmp_path}/all")
    assert set(tables.load_all(spark, f"{tmp_path}/all", ["m", "n"])) == {"m", "n"}
    tables.concat_files(spark, [f"{tmp_path}/all/m", f"{tmp_path}/all/n"], f"{tmp_path}/both")
    assert tables.load(spark, f"{tmp_path}/both").count() == 4
    j = spark.createDataFrame([(1, [1, 2]), (2, [3])], "k int, v array<int>")
    assert rows(tables.jagged(j, "v", 2, fill=0), "k") == [(1, 1, 2), (2, 3, 0)] and tables.jagged(j, "v").count() == 3
    assert tables.tile(j, 3).count() == 6 and rows(tables.as_matrix(j.select("k")).select("matrix"), "matrix") == [([1.0],), ([2.0],)]
    assert tables.append_keyed({"p": j, "q": j.drop("v")}, "src").where("src = 'q' and v is null").count() == 2


def test_membership(spark, df):
    other = spark.createDataFrame([("a", 9), ("a", 8)], "k string, o int")
    assert [(r["k"], r["member"], r["at"]) for r in joins.ismember(df, other, "k", index="at", order="o").orderBy("i").collect()] == [("a", True, 8), ("a", True, 8), ("b", False, None), ("b", False, None)]
    assert joins.isin(df, other, "k").count() == 2 and joins.isin(df, other, "k", negate=True).count() == 2


def test_percentiles_hold_no_column_in_one_task(spark, monkeypatch):
    """The same quantiles as F.percentile, for ties, missing and few values too, but no aggregate gathers a column's values."""
    monkeypatch.setattr(stats, "PARTS", 8, raising=False)
    df = spark.range(3000).selectExpr("id % 7 as few", "if(id % 5 = 0, null, cast(hash(id) as double)) as many", "cast(null as double) as none", "if(id = 9, -0.5D, null) as one", "if(id < 2900, 1D, id) as hot")
    qs = [0, 0.1, 0.25, 0.333, 0.5, 0.9, 0.999, 1]
    for d in (df, df.where("false")):
        got, want = stats.percentiles(d, d.columns, qs).first(), d.agg(*[F.percentile(c, F.array(*map(F.lit, qs))).alias(c) for c in d.columns]).first()
        assert got == want
    assert " percentile(" not in stats.describe(df)._jdf.queryExecution().optimizedPlan().toString().replace("[", " ")
