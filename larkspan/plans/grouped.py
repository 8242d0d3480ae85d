"""Queries of grouping, reducing and deduplication, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspan.functions import aggregates as A
from larkspan.functions import stats
from larkspan.operators import select
from larkspan.operators.group import Group, drop_duplicates, duplicated, unique
from larkspan.operators.joins import lookup
from larkspan.sources.tables import load

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df, n: int = 4):
    """Doubles to n digits, as sums of doubles depend on their order."""
    return df.select(*[F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def table(spark, sf, name, *columns):
    return load(spark, f"{sf}/{name}.parquet", include=columns or None)


#: A value that is missing on every seventh row, the same on both sides.
GAPS = "case when event_id % 7 = 0 then null else value end"


def gaps(spark, sf):
    return table(spark, sf, "events", "event_id", "user_id", "event_type", "value").withColumn("x", F.expr(GAPS))


@query("""
select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 4) as sum_qty, round(avg(l_extendedprice), 4) as mean_price, round(stddev_samp(l_extendedprice), 4) as std_price,
    round(median(l_quantity), 4) as median_qty, count(distinct o_orderpriority) as priorities
from lineitem left join (select distinct on (o_orderkey) * from orders order by o_orderkey) o on l_orderkey = o_orderkey
where l_shipdate >= timestamp '1994-01-01' group by all""")
def groupby_basic(spark, sf):
    lines = load(spark, f"{sf}/lineitem.parquet", where=F.col("l_shipdate") >= F.lit("1994-01-01").cast("timestamp"), include=["l_orderkey", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice"])
    x = lookup(lines, table(spark, sf, "orders", "o_orderkey", "o_orderpriority").withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")
    return rounded(Group(x, ["l_returnflag", "l_linestatus"]).reduce(
        A.count().alias("n"), A.sum_("l_quantity").alias("sum_qty"), A.mean("l_extendedprice").alias("mean_price"), A.std("l_extendedprice").alias("std_price"), A.median("l_quantity").alias("median_qty"), A.count_uniques("o_orderpriority").alias("priorities")))


@query("select l_returnflag, round(sum(l_quantity), 4) as l_quantity, round(sum(l_tax), 4) as l_tax from lineitem group by all")
def gb_sum(spark, sf):
    return rounded(Group(table(spark, sf, "lineitem", "l_returnflag", "l_quantity", "l_tax"), "l_returnflag").sum())


@query(f"""
with x as (select event_type, {GAPS} as x from events)
select event_type, case when count(x) = count(*) then round(sum(x), 4) end as strict_sum, round(coalesce(sum(x), 0), 4) as nan_sum, round(avg(x), 4) as nan_mean, round(min(x), 4) as nan_min,
    round(max(x), 4) as nan_max, round(var_samp(x), 4) as nan_var, round(stddev_samp(x), 4) as nan_std, round(median(x), 4) as nan_median from x group by event_type""")
def gb_missing(spark, sf):
    return rounded(Group(gaps(spark, sf), "event_type").reduce(*[f("x").alias(n) for n, f in (("strict_sum", A.sum_), ("nan_sum", A.nansum), ("nan_mean", A.nanmean), ("nan_min", A.nanmin), ("nan_max", A.nanmax), ("nan_var", A.nanvar), ("nan_std", A.nanstd), ("nan_median", A.nanmedian))]))


@query("""
select o_orderpriority, round(avg(o_totalprice), 4) as o_totalprice_mean, round(max(o_totalprice), 4) as o_totalprice_max, round(min(o_totalprice), 4) as o_totalprice_min, round(arg_min(o_totalprice, o_orderkey), 4) as o_totalprice_first,
    round(arg_max(o_totalprice, o_orderkey), 4) as o_totalprice_last, count(*) as o_totalprice_count, count(distinct o_custkey) as o_custkey_count_uniques from orders group by 1""")
def gb_agg(spark, sf):
    x = table(spark, sf, "orders", "o_orderpriority", "o_totalprice", "o_orderkey", "o_custkey")
    return rounded(Group(x, "o_orderpriority", "o_orderkey").agg({"o_totalprice": ["mean", "max", "min", "first", "last", "count"], "o_custkey": "count_uniques"}))


@query("select event_type, count(*) filter (where value > 50) as n, count(distinct case when value > 50 then user_id end) as users from events group by 1")
def gb_filter(spark, sf):
    x = table(spark, sf, "events", "event_type", "value", "user_id")
    keep = F.col("value") > 50
    return Group(x, "event_type").reduce(A.count(keep).alias("n"), A.count_uniques("user_id", keep).alias("users"))


@query("select event_type, round(sum(value), 4) as value from events where value > 50 group by 1")
def gb_construction_filter(spark, sf):
    return rounded(Group(table(spark, sf, "events", "event_type", "value"), "event_type", where=F.col("value") > 50).sum())


@query("""
with l as (select user_id, list(value order by event_id) as v from events group by 1)
select user_id, v[1] as first, v[3] as third, v[-1] as last, v[-2] as before_last from l""")
def gb_nth(spark, sf):
    g = Group(table(spark, sf, "events", "user_id", "value", "event_id"), "user_id", "event_id")["value"]
    made = [g.nth(n).withColumnRenamed("value", k) for k, n in (("first", 0), ("third", 2), ("last", -1), ("before_last", -2))]
    out = made[0]
    for m in made[1:]:
        out = out.join(m, "user_id")
    return out


@query(f"""
with x as (select event_type, {GAPS} as x from events), l as (select event_type, list_sort(list(x) filter (where x is not null)) as s from x group by 1)
select event_type, round((s[(floor(.25 * (len(s) - 1)) + 1)::int] + s[(ceil(.25 * (len(s) - 1)) + 1)::int]) / 2, 6) as x_q0_25, round((s[(floor(.9 * (len(s) - 1)) + 1)::int] + s[(ceil(.9 * (len(s) - 1)) + 1)::int]) / 2, 6) as x_q0_9 from l""")
def gb_quantile(spark, sf):
    return rounded(Group(gaps(spark, sf), "event_type")["x"].quantile([0.25, 0.9]), 6)


@query("select event_type, event_id, round(value - avg(value) over (partition by event_type), 4) as off, count(*) over (partition by event_type) as n from events")
def gb_transform(spark, sf):
    x = Group(table(spark, sf, "events", "event_type", "event_id", "value"), "event_type").transform(m=F.avg("value"), n=F.count(F.lit(1)))
    return rounded(x.select("event_type", "event_id", (F.col("value") - F.col("m")).alias("off"), "n"))


@query("""
with c as (select l_returnflag, l_quantity, count(*) as n from lineitem group by all)
select l_returnflag, l_quantity as mode from (select *, row_number() over (partition by l_returnflag order by n desc, l_quantity) as r from c) where r = 1""")
def gb_mode(spark, sf):
    return Group(table(spark, sf, "lineitem", "l_returnflag", "l_quantity"), "l_returnflag").reduce(A.mode("l_quantity").alias("mode"))


@query("select event_type, arg_min(value, event_id) as open, max(value) as high, min(value) as low, arg_max(value, event_id) as close from events group by 1")
def gb_ohlc(spark, sf):
    return Group(table(spark, sf, "events", "event_type", "event_id", "value"), "event_type", "event_id").ohlc("value")


@query("""
select l_returnflag, l_linestatus, round(sum(l_quantity), 4) as l_quantity, round(avg(l_tax), 6) as l_tax, l_returnflag is null as is_total
from lineitem group by grouping sets ((l_returnflag, l_linestatus), ())""")
def gb_totals(spark, sf):
    x = table(spark, sf, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_tax")
    return rounded(Group(x, ["l_returnflag", "l_linestatus"]).totals({"l_quantity": "nansum", "l_tax": "nanmean"}), 6)


@query("select r_name, n_name, coalesce(c, 0) as count from region cross join (select distinct n_name from nation) left join (select r_name as r, n_name as n, count(*) as c from nation join region on n_regionkey = r_regionkey group by all) x on r = r_name and n = n_name")
def gb_all_categories(spark, sf):
    n = table(spark, sf, "nation", "n_name", "n_regionkey")
    r = table(spark, sf, "region", "r_regionkey", "r_name")
    x = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("r_name", "n_name")
    return Group(x, ["r_name", "n_name"], categories=r.select("r_name").crossJoin(n.select("n_name").distinct())).count()


@query("select event_id, dense_rank() over (order by event_type) - 1 as ngroup from events")
def gb_ngroup(spark, sf):
    return Group(table(spark, sf, "events", "event_type", "event_id"), "event_type").ngroup().select("event_id", "ngroup")


@query("select event_id, rank() over (partition by event_type order by round(value)) + (count(*) over (partition by event_type, round(value)) - 1) / 2.0::double as rank from events")
def gb_rank(spark, sf):
    x = table(spark, sf, "events", "event_type", "event_id", "value").withColumn("v", F.round("value"))
    return Group(x, "event_type").rank("v").select("event_id", "rank")


@query("select * exclude (r) from (select event_type, event_id, value, row_number() over (partition by event_type order by event_id) as r from events) where r <= 3")
def gb_head(spark, sf):
    return Group(table(spark, sf, "events", "event_type", "event_id", "value"), "event_type", "event_id").head(3)


@query("select event_type, round(stddev_samp(value) / sqrt(count(value)), 6) as value from events group by 1")
def gb_sem(spark, sf):
    return rounded(Group(table(spark, sf, "events", "event_type", "value"), "event_type").sem(), 6)


@query("select event_type, event_id, value from (select event_type, event_id, value, row_number() over (partition by event_type order by value desc, event_id desc) as r from events) where r <= 3")
def gb_apply(spark, sf):
    x = table(spark, sf, "events", "event_type", "event_id", "value")
    return Group(x, "event_type").apply(lambda p: p.nlargest(3, ["value", "event_id"]), "event_type string, event_id long, value double")


@query("select event_type, round(max(value) - min(value), 6) as value from events group by 1")
def gb_apply_reduce(spark, sf):
    def spread(v):
        return float(v.max() - v.min())

    return rounded(Group(table(spark, sf, "events", "event_type", "value"), "event_type")["value"].apply_reduce(spread), 6)


@query("select o_custkey, count(*) as count, min(o_orderkey) as first from orders group by 1")
def unique_keys(spark, sf):
    return unique(table(spark, sf, "orders", "o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("select * exclude (r) from (select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_orderkey) as r from orders) where r = 1")
def drop_duplicates_first(spark, sf):
    return drop_duplicates(table(spark, sf, "orders", "o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey")


@query("select * exclude (r) from (select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_orderkey desc) as r from orders) where r = 1")
def drop_duplicates_last(spark, sf):
    return drop_duplicates(table(spark, sf, "orders", "o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey", "last")


@query("select o_orderkey, count(*) over (partition by o_custkey) > 1 as duplicated from orders")
def duplicated_any(spark, sf):
    return duplicated(table(spark, sf, "orders", "o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", False).select("o_orderkey", "duplicated")


@query(" union all ".join(f"""select '{c}' as "column", count(*) as count, count({c}) as valid, count(*) - count({c}) as missing, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std, round(min({c})::double, 4) as min,
    {', '.join(f'round(quantile_cont({c}, {q}), 4) as p{int(q * 100)}' for q in (.1, .25, .5, .75, .9))}, round(max({c})::double, 4) as max,
    round((select avg({c}) from lineitem where {c} between (select quantile_cont({c}, .1) from lineitem) and (select quantile_cont({c}, .9) from lineitem)), 4) as mean_m from lineitem""" for c in ("l_quantity", "l_extendedprice", "l_tax")))
def describe(spark, sf):
    return rounded(stats.describe(table(spark, sf, "lineitem", "l_quantity", "l_extendedprice", "l_tax")))


@query("select round(sum(l_quantity), 4) as l_quantity, round(sum(l_tax), 4) as l_tax from lineitem")
def reduce_sum(spark, sf):
    return rounded(stats.reduce_columns(table(spark, sf, "lineitem", "l_quantity", "l_tax"), "sum"))


@query("select vec_id, round(list_sum(e), 5) + 0.0 as row_sum, round(list_avg(e), 5) + 0.0 as row_mean, round(list_min(e), 5) as row_min, round(list_max(e), 5) as row_max, round(list_stddev_samp(e), 5) as row_std from (select vec_id, [embedding[1]::double, embedding[2]::double, embedding[3]::double, embedding[4]::double] as e from embeddings)")
def rowwise(spark, sf):
    names = [f"e{i}" for i in range(4)]
    x = select.matrix_columns(table(spark, sf, "embeddings", "vec_id", "embedding"), "embedding", names)
    for how in ("sum", "mean", "min", "max", "std"):
        x = select.rowwise(x, how, names)
    return rounded(x.select("vec_id", *[f"row_{h}" for h in ("sum", "mean", "min", "max", "std")]), 5)


@query("""select 'o_totalprice' as "column", arg_min(o_orderkey, o_totalprice) as low_key, min(o_totalprice) as low, arg_max(o_orderkey, o_totalprice) as high_key, max(o_totalprice) as high from orders""")
def outliers(spark, sf):
    return select.outliers(table(spark, sf, "orders", "o_orderkey", "o_totalprice"), "o_orderkey")


@query("select round(pow(corr(l_quantity, l_extendedprice), 2), 6) as r2, round(avg(abs(l_discount - l_tax)), 6) as mae, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept from lineitem")
def fits(spark, sf):
    c = F.col
    slope, intercept = stats.line(c("l_extendedprice"), c("l_quantity"))
    return table(spark, sf, "lineitem", "l_quantity", "l_extendedprice", "l_discount", "l_tax").agg(F.round(stats.r2(c("l_quantity"), c("l_extendedprice")), 6).alias("r2"), F.round(stats.mae(c("l_discount"), c("l_tax")), 6).alias("mae"), F.round(slope, 4).alias("slope"), F.round(intercept, 4).alias("intercept"))


@query("select 'l_quantity' as term, round(regr_slope(l_extendedprice, l_quantity), 3) as weight from lineitem union all select 'intercept', round(regr_intercept(l_extendedprice, l_quantity), 3) from lineitem")
def least_squares(spark, sf):
    return rounded(stats.least_squares(table(spark, sf, "lineitem", "l_quantity", "l_extendedprice"), "l_extendedprice", ["l_quantity"]), 3)
