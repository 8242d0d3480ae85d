"""Queries of selection, sorting, cross-tables, reshaping, binning and strings, dates and numbers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspan.functions import aggregates as A
from larkspan.functions import math as M
from larkspan.functions import strings as S
from larkspan.functions import temporal as D
from larkspan.operators import category as C
from larkspan.operators import crosstab as X
from larkspan.operators import select
from larkspan.plans.grouped import rounded, table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


FLAGS, STATUS, PRIORITIES = ["A", "N", "R"], ["F", "O"], ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def lines(spark, sf):
    return table(spark, sf, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount")


@query("select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as net from lineitem where l_shipdate >= timestamp '1995-01-01' and l_shipdate < timestamp '1996-01-01' and l_quantity between 10 and 20")
def filter_project(spark, sf):
    x = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_shipdate", "l_quantity")
    keep = select.mask_and(select.between(F.col("l_shipdate"), F.lit("1995-01-01").cast("timestamp"), F.lit("1996-01-01").cast("timestamp")), select.between(F.col("l_quantity"), 10, 20, include_high=True))
    return select.take(x, keep).select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100")
def sort_topk(spark, sf):
    return select.head(table(spark, sf, "orders", "o_orderkey", "o_totalprice"), 100, ("o_totalprice", False), "o_orderkey")


@query("select event_id, x from (select event_id, case when event_id % 7 = 0 then null else value end as x from events) order by x desc nulls first, event_id desc limit 50")
def tail_missing(spark, sf):
    x = table(spark, sf, "events", "event_id", "value").select("event_id", F.expr("case when event_id % 7 = 0 then null else value end").alias("x"))
    return select.tail(x, 50, "x", "event_id")


@query("select count(*) = 0 as sorted from (select ts < lag(ts) over (order by event_id) as down from events) where down")
def is_sorted(spark, sf):
    return select.is_sorted(table(spark, sf, "events", "event_id", "ts"), "ts", "event_id")


@query("select c_custkey, c_name from (select *, row_number() over (order by md5(c_custkey || '/7'), c_custkey) as r from customer) where r <= 50")
def sample(spark, sf):
    return select.hashed_sample(table(spark, sf, "customer", "c_custkey", "c_name"), 50, "c_custkey", 7)


@query("select c_custkey, c_mktsegment in ('BUILDING', 'MACHINERY') as big, case when c_acctbal < 0 then 0 else round(c_acctbal, 4) end as bal, (c_acctbal < 0) <> (c_nationkey > 10) as odd from customer")
def masks(spark, sf):
    x = table(spark, sf, "customer", "c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")
    x = select.put(x.withColumn("bal", F.round("c_acctbal", 4)), "bal", F.col("c_acctbal") < 0, 0.0)
    return x.select("c_custkey", F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("big"), "bal", select.mask_xor(F.col("c_acctbal") < 0, F.col("c_nationkey") > 10).alias("odd"))


@query("select r_regionkey as key_region, r_name as name_region, 1 as a, 0 as z from region")
def rename_move(spark, sf):
    x = table(spark, sf, "region", "r_name", "r_regionkey")
    x = select.add_suffix(select.rename(x, lambda c: c.removeprefix("r_").removeprefix("region")), "_region").withColumns({"z": F.lit(1), "a": F.lit(0)})
    return select.move(select.swap(x, "a", "z"), ["key_region"])


@query("select event_id, round(value * 2 + 10, 4) as value from events")
def table_arithmetic(spark, sf):
    x = table(spark, sf, "events", "event_id", "value")
    tens = x.withColumn("value", F.lit(10.0))
    return rounded(select.arithmetic(select.arithmetic(x, 2, "mul", "event_id"), tens, "add", "event_id"))


@query("select o_orderkey, o_orderkey % 7 <> 0 or o_orderkey % 5 = 0 as same, true as in_both from orders")
def table_equals(spark, sf):
    """Against a copy with every seventh value changed; missing equals missing."""
    x = table(spark, sf, "orders", "o_orderkey", "o_totalprice").withColumn("o_totalprice", F.expr("case when o_orderkey % 5 = 0 then null else o_totalprice end"))
    return select.equals(x, x.withColumn("o_totalprice", F.expr("o_totalprice + case when o_orderkey % 7 = 0 then 1 else 0 end")), "o_orderkey").withColumnRenamed("o_totalprice", "same")


@query("select event_id, z, y from (select event_id, case when event_id % 2 = 0 then 0 else value end as z, value as y, 0 as dead from events) where z <> 0 or y <> 0")
def trim(spark, sf):
    x = table(spark, sf, "events", "event_id", "value").select("event_id", F.when(F.col("event_id") % 2 == 0, 0.0).otherwise(F.col("value")).alias("z"), F.col("value").alias("y"), F.lit(0.0).alias("dead"))
    return select.trim(x, ["z", "y", "dead"])


def _cross(value: str, agg: str, names: list[str]) -> str:
    a = lambda cond: f"{agg.format(value)} filter (where {cond})"
    cols = ", ".join(f"round({a(f'l_linestatus = {n!r}')}, 4) as \"{n}\"" for n in names)
    return f"select l_returnflag, l_returnflag is null as is_total, {cols}, round({agg.format(value)}, 4) as \"Total\" from lineitem group by grouping sets ((l_returnflag), ())"


for _n, _f, _a in (("accum2_sum", A.nansum, "sum({})"), ("accum2_mean", A.nanmean, "avg({})"), ("accum2_median", A.nanmedian, "median({})"), ("accum2_std", A.nanstd, "stddev_samp({})")):
    def _run(spark, sf, f=_f):
        return rounded(X.crosstab(lines(spark, sf), "l_returnflag", "l_linestatus", f, "l_quantity", STATUS))

    Q[_n], SQL[_n] = _run, _cross("l_quantity", _a, STATUS)


@query('select o_orderpriority, o_orderpriority is null as is_total, count(*) filter (where o_orderstatus = \'F\') as "F", count(*) filter (where o_orderstatus = \'O\') as "O", count(*) filter (where o_orderstatus = \'P\') as "P", count(*) as "Total" from orders group by grouping sets ((o_orderpriority), ())')
def accum2_count(spark, sf):
    return X.crosstab(table(spark, sf, "orders", "o_orderpriority", "o_orderstatus"), "o_orderpriority", "o_orderstatus", F.count, names=["F", "O", "P"], fill=0)


_RATIO = "round(sum(l_extendedprice * l_discount) {0} / sum(l_extendedprice) {0}, 6)"


@query("select l_returnflag, l_returnflag is null as is_total, " + ", ".join(_RATIO.format(f"filter (where l_linestatus = '{n}')") + f' as "{n}"' for n in STATUS) + f", {_RATIO.format('')} as \"Total\" from lineitem group by grouping sets ((l_returnflag), ())")
def accum_ratio(spark, sf):
    return rounded(X.ratio(lines(spark, sf), "l_returnflag", "l_linestatus", F.sum(F.col("l_extendedprice") * F.col("l_discount")), F.sum("l_extendedprice"), STATUS), 6)


for _by in "TRC":
    def _pct(spark, sf, by=_by):
        return rounded(X.percent(lines(spark, sf), "l_returnflag", "l_linestatus", F.sum("l_quantity"), by, STATUS))

    _margin = {"T": "(select sum(l_quantity) from lineitem)", "R": "sum(l_quantity)", "C": "(select sum(l_quantity) from lineitem where l_linestatus = '{n}')"}[_by]
    _whole = {"T": "(select sum(l_quantity) from lineitem)", "R": "sum(l_quantity)", "C": "(select sum(l_quantity) from lineitem)"}[_by]
    Q[f"accum_percent_{_by}"] = _pct
    SQL[f"accum_percent_{_by}"] = "select l_returnflag, l_returnflag is null as is_total, " + ", ".join(f"round(coalesce(100 * sum(l_quantity) filter (where l_linestatus = '{n}') / {_margin.format(n=n)}, 0), 4) as \"{n}\"" for n in STATUS) + f", round(100 * sum(l_quantity) / {_whole}, 4) as \"Total\" from lineitem group by grouping sets ((l_returnflag), ())"


@query("select o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as price, round(avg(o_totalprice), 4) as mean, o_orderpriority is null as is_total from orders group by rollup (o_orderpriority)")
def accum_cols(spark, sf):
    x = X.side_by_side(table(spark, sf, "orders", "o_orderpriority", "o_totalprice"), "o_orderpriority", n=A.count(), price=F.round(F.sum("o_totalprice"), 2), mean=F.avg("o_totalprice"))
    return rounded(x)


@query("select user_id, " + ", ".join(f"max(v) filter (where event_type = '{t}') as \"{t}\"" for t in ("click", "purchase")) + " from (select user_id, event_type, round(sum(value), 4) as v from events where event_type in ('click', 'purchase') group by all) group by user_id")
def pivot(spark, sf):
    x = table(spark, sf, "events", "user_id", "event_type", "value").where(F.col("event_type").isin("click", "purchase")).groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 4).alias("v"))
    return X.pivot(x, "user_id", "event_type", "v", ["click", "purchase"])


@query("select l_orderkey, l_linenumber, l_partkey, variable, value from (unpivot (select l_orderkey, l_linenumber, l_partkey, l_tax, l_discount from lineitem) on l_tax, l_discount into name variable value value) where value <> 0")
def melt(spark, sf):
    x = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_tax", "l_discount")
    return X.melt(x, ["l_orderkey", "l_linenumber", "l_partkey"], ["l_tax", "l_discount"], trim=True)


@query("select o_orderkey, " + ", ".join(f"(o_orderstatus = '{s}')::int as s_{s}" for s in "FOP") + " from orders")
def one_hot(spark, sf):
    return X.one_hot(table(spark, sf, "orders", "o_orderkey", "o_orderstatus"), "o_orderstatus", list("FOP"), "s").drop("o_orderstatus")


@query("""with r as (select min(c_acctbal) as a, max(c_acctbal) as b from customer) select c_custkey, case when c_acctbal <= a + (b - a) * 1 / 4 then 1 when c_acctbal <= a + (b - a) * 2 / 4 then 2 when c_acctbal <= a + (b - a) * 3 / 4 then 3 else 4 end as bin from customer, r""")
def cut(spark, sf):
    return X.cut(table(spark, sf, "customer", "c_custkey", "c_acctbal"), "c_acctbal", 4).drop("c_acctbal")


@query("select p_partkey, case when p_size between 1 and 10 then 1 when p_size > 10 and p_size <= 25 then 2 when p_size > 25 and p_size <= 40 then 3 else 0 end as bin, case when p_size between 1 and 10 then '1.0->10.0' when p_size > 10 and p_size <= 25 then '10.0->25.0' when p_size > 25 and p_size <= 40 then '25.0->40.0' else 'Filtered' end as label from part")
def cut_edges(spark, sf):
    return X.cut(table(spark, sf, "part", "p_partkey", "p_size"), "p_size", [1, 10, 25, 40], label="label").drop("p_size")


@query("with q as (select quantile_cont(o_totalprice, [0, .25, .5, .75, 1]) as e from orders) select o_orderkey, case when o_totalprice <= e[2] then 2 when o_totalprice <= e[3] then 3 when o_totalprice <= e[4] then 4 else 5 end as bin from orders, q")
def qcut(spark, sf):
    return X.qcut(table(spark, sf, "orders", "o_orderkey", "o_totalprice"), "o_totalprice", 4).drop("o_totalprice")


@query("with q as (select event_type as t, quantile_cont(value, [0, .5, 1]) as e from events group by 1) select event_id, case when value <= e[2] then 2 else 3 end as bin from events join q on t = event_type")
def qcut_groups(spark, sf):
    return X.cut_groups(table(spark, sf, "events", "event_id", "event_type", "value"), "value", "event_type", 2).select("event_id", "bin")


@query("select p_partkey, case when count(*) over (partition by p_size) >= (select avg(c) from (select count(*) as c from part group by p_size)) then p_size::varchar else 'misc' end as size from part")
def rare_values(spark, sf):
    x = table(spark, sf, "part", "p_partkey", "p_size")
    mean = x.groupBy("p_size").count().agg(F.ceil(F.avg("count"))).first()[0]
    return X.rare(x.withColumn("size", F.col("p_size").cast("string")), "size", mean).drop("p_size")


@query("select p_partkey, upper(p_name) as up, reverse(p_brand) as back, length(p_type)::int as n, (position('a' in p_name) - 1)::int as at, starts_with(p_brand, 'Brand') as brand, replace(p_type, ' ', '_') as under, regexp_extract(p_brand, '([A-Za-z]+)#(\\d)', 1) as word, regexp_extract(p_brand, '([A-Za-z]+)#(\\d)', 2) as digit, p_name[2:4] as mid, regexp_replace(p_brand, '(\\d)', '<\\1>', 'g') as marked, p_name[-3:] as tail, p_brand || '_' || p_size as keys from part")
def strings(spark, sf):
    x = table(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    c = F.col
    word, digit = S.extract(c("p_brand"), r"([A-Za-z]+)#(\d)", ["word", "digit"])
    return x.select(
        "p_partkey", S.upper("p_name").alias("up"), S.reverse("p_brand").alias("back"), S.length("p_type").alias("n"), S.index(c("p_name"), "a").alias("at"), c("p_brand").startswith("Brand").alias("brand"), S.replace(c("p_type"), " ", "_").alias("under"), word, digit,
        S.substr(c("p_name"), 1, 4).alias("mid"), S.regex_replace(c("p_brand"), r"(\d)", r"<\1>").alias("marked"), S.substr(c("p_name"), -3).alias("tail"), S.join_keys(c("p_brand"), c("p_size").cast("string")).alias("keys"))


@query("select c_custkey, case c_mktsegment when 'BUILDING' then 'b' when 'MACHINERY' then 'm' else 'other' end as seg from customer")
def relabel(spark, sf):
    return S.relabel(table(spark, sf, "customer", "c_custkey", "c_mktsegment"), "c_mktsegment", {"BUILDING": "b", "MACHINERY": "m"}, "other", "seg").drop("c_mktsegment")


@query("""select event_id, year(ts)::int as year, quarter(ts)::int as quarter, month(ts)::int as month, day(ts)::int as day, dayofyear(ts)::int as doy, (isodow(ts) - 1)::int as dow, isodow(ts) >= 6 as weekend, strftime(date_trunc('month', ts), '%Y-%m-%d') as month_start, strftime(last_day(ts), '%Y-%m-%d') as month_end, strftime(date_trunc('week', ts), '%Y-%m-%d') as week_start,
    round((epoch_us(ts) % 86400000000) / 3600e6, 6) as hours, round((epoch_us(ts) % 3600000000) / 60e6, 6) as minutes, strftime(ts, '%Y%m%d %H:%M:%S') as text, (epoch_us(ts) // 86400000000)::int as days, (dayofyear(make_date(year(ts)::int, 12, 31)) = 366) as leap from events""")
def date_parts(spark, sf):
    t = F.col("ts")
    out = {"year": "year", "quarter": "quarter", "month": "month", "day": "day_of_month", "doy": "day_of_year", "dow": "day_of_week", "weekend": "is_weekend", "leap": "is_leapyear"}
    starts = {k: F.date_format(D.part(t, k), "yyyy-MM-dd").alias(k) for k in ("month_start", "month_end", "week_start")}
    return table(spark, sf, "events", "event_id", "ts").select("event_id", *[D.part(t, v).alias(k) for k, v in out.items()], *starts.values(), F.round(D.fraction(t, "hour"), 6).alias("hours"), F.round(D.fraction(t, "minute"), 6).alias("minutes"), D.strftime(t, "%Y%m%d %H:%M:%S").alias("text"), D.days_since_epoch(t).alias("days"))


@query("select event_id, hour((ts at time zone 'UTC') at time zone 'America/New_York')::int as hour, round((epoch_us((ts at time zone 'UTC') at time zone 'America/New_York') - epoch_us(ts)) / 3600e6, 4) as ahead, strftime((ts at time zone 'UTC') at time zone 'America/New_York', '%Y-%m-%d') as day from events")
def time_zone(spark, sf):
    t, z = F.col("ts"), "America/New_York"
    return table(spark, sf, "events", "event_id", "ts").select("event_id", F.hour(D.local(t, z)).alias("hour"), F.round(D.offset(t, z), 4).alias("ahead"), D.strftime(t, "%Y-%m-%d", z).alias("day"))


@query("select epoch_us(ts) // 900000000 * 900 as start, count(*) as n, round(sum(value), 4) as total from events group by 1")
def resample(spark, sf):
    x = table(spark, sf, "events", "ts", "value").groupBy(D.floor_to(F.col("ts"), "15T").alias("s")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return x.select(F.unix_seconds("s").alias("start"), "n", "total")


@query("select unnest(range(min(epoch_us(ts)) // 3600000000, max(epoch_us(ts)) // 3600000000 + 1)) * 3600 as start from events")
def regular_range(spark, sf):
    return D.regular(table(spark, sf, "events", "ts"), "ts", "H").select(F.unix_seconds("ts").alias("start"))


@query("select event_id, case when epoch_us(ts) % 86400000000 >= 57600000000 then 3 when epoch_us(ts) % 86400000000 >= 43200000000 then 2 when epoch_us(ts) % 86400000000 >= 34200000000 then 1 else 0 end as bin from events")
def cut_time(spark, sf):
    return table(spark, sf, "events", "event_id", "ts").select("event_id", D.cut_time(F.col("ts"), ["09:30", "12:00", "16:00"]).alias("bin"))


@query("select p_partkey, round(case when p_size <= 1 then 0 when p_size < 10 then (p_size - 1) / 9.0 when p_size < 40 then 1 + (p_size - 10) / 30.0 else 2 end, 6) as y, least(greatest(p_size, 5), 30) as clipped, round(p_retailprice / nullif(p_size - 10, 0), 6) as share, bit_count(p_size)::int as bits from part")
def numbers(spark, sf):
    c = F.col("p_size")
    return table(spark, sf, "part", "p_partkey", "p_size", "p_retailprice").select("p_partkey", F.round(M.interpolate(c, [1, 10, 40], [0, 1, 2]), 6).alias("y"), M.clip(c, 5, 30).alias("clipped"), F.round(M.divide(F.col("p_retailprice"), c - 10), 6).alias("share"), F.bit_count(c).alias("bits"))


@query("select event_id, round((value - avg(value) over ()) / stddev_samp(value) over (), 6) as zscore, round((value - min(value) over ()) / (max(value) over () - min(value) over ()), 6) as minmax from events")
def normalize(spark, sf):
    x = table(spark, sf, "events", "event_id", "value")
    return rounded(M.minmax(M.zscore(x, "value"), "value").drop("value"), 6)


@query("with q as (select event_type as t, quantile_cont(value, .1) as a, quantile_cont(value, .9) as b from events group by 1) select event_id, round(least(greatest(value, a), b), 6) as clipped, case when value between a and b then value end as kept from events join q on t = event_type")
def winsorize(spark, sf):
    x = M.winsorize(table(spark, sf, "events", "event_id", "event_type", "value"), "value", 0.1, 0.9, "event_type", "clipped")
    return M.trim_groups(x, "value", "event_type", 0.1, 0.9, "kept").select("event_id", F.round("clipped", 6).alias("clipped"), "kept")


@query("select o_orderkey, case when o_totalprice > 1000 then dense_rank() over (order by o_orderpriority) else 0 end as code, case when o_totalprice > 1000 then o_orderpriority else 'Filtered' end as label from orders")
def category_codes(spark, sf):
    x = table(spark, sf, "orders", "o_orderkey", "o_orderpriority", "o_totalprice")
    dim = C.dimension(x, "o_orderpriority")
    return C.decode(C.encode(x, "o_orderpriority", dim, F.col("o_totalprice") > 1000), dim).select("o_orderkey", "code", "label")


@query("select case when o_totalprice > 100000 then o_orderpriority else 'Filtered' end as priority, count(*) as n from orders group by 1")
def category_shown(spark, sf):
    x = table(spark, sf, "orders", "o_orderpriority", "o_totalprice")
    return x.groupBy(C.shown(F.col("o_orderpriority"), F.col("o_totalprice") > 100000).alias("priority")).agg(F.count(F.lit(1)).alias("n"))


@query("select c_custkey, case c_nationkey when 0 then 'zero' when 1 then 'one' else '!<' || c_nationkey || '>' end as label from customer")
def category_mapped(spark, sf):
    return C.mapped(table(spark, sf, "customer", "c_custkey", "c_nationkey"), "c_nationkey", {0: "zero", 1: "one"}).drop("c_nationkey")


@query("""with g as (select l_returnflag, l_linestatus, grouping(l_returnflag) as r, grouping(l_linestatus) as c, round(sum(l_quantity), 4) as s, round(avg(l_quantity), 4) as m from lineitem group by cube (l_returnflag, l_linestatus))
select l_returnflag, max(s) filter (where l_linestatus = 'F' and c = 0) as "F", max(s) filter (where l_linestatus = 'O' and c = 0) as "O", max(m) filter (where c = 1) as mean, 'cells' as kind from g where r = 0 group by l_returnflag
union all select null, max(m) filter (where l_linestatus = 'F' and c = 0), max(m) filter (where l_linestatus = 'O' and c = 0), null, 'mean' from g where r = 1""")
def accum_table(spark, sf):
    x = lines(spark, sf)
    made = {"total": X.crosstab(x, "l_returnflag", "l_linestatus", A.nansum, "l_quantity", STATUS), "mean": X.crosstab(x, "l_returnflag", "l_linestatus", A.nanmean, "l_quantity", STATUS)}
    return rounded(X.compose(made, "l_returnflag", ["mean"], ["mean"], STATUS))


@query("select key, value from (select 'l_tax' as key, round(sum(l_tax), 4) as value from lineitem union all select 'l_discount', round(sum(l_discount), 4) from lineitem)")
def transpose(spark, sf):
    x = table(spark, sf, "lineitem", "l_tax", "l_discount").agg(F.sum("l_tax").alias("l_tax"), F.sum("l_discount").alias("l_discount")).withColumn("name", F.lit("value"))
    return rounded(X.transpose(x, "name").withColumnRenamed("column", "key"))


@query("select member, r_name as name, r_regionkey as number from (select 'region' as member, r_name, r_regionkey from region union all select 'nation', n_name, n_regionkey from nation)")
def container_vertical(spark, sf):
    members = {"region": table(spark, sf, "region", "r_name", "r_regionkey").toDF("name", "number"), "nation": table(spark, sf, "nation", "n_name", "n_regionkey").toDF("name", "number")}
    return select.vertical(members)


@query("select coalesce(a.k, b.k) as k, a_n, b_n from (select o_custkey as k, count(*) as a_n from orders where o_orderstatus = 'F' group by 1) a full join (select o_custkey as k, count(*) as b_n from orders where o_orderstatus = 'O' group by 1) b on a.k = b.k")
def container_horizontal(spark, sf):
    o = table(spark, sf, "orders", "o_custkey", "o_orderstatus")
    count = lambda s: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return select.horizontal({"a": count("F"), "b": count("O")}, "k")


@query("select i as at, c_custkey, c_name from (values (0, 5), (1, 3), (2, 5), (3, -1)) v(i, k) left join customer on c_custkey = k")
def take_by_position(spark, sf):
    want = spark.createDataFrame([(0, 5), (1, 3), (2, 5), (3, -1)], "at int, c_custkey long")
    return select.take_ids(table(spark, sf, "customer", "c_custkey", "c_name"), want, "c_custkey", "at")
