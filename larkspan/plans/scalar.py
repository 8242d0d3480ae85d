"""Queries of scalar families, row tests, group access, ungrouped windows and operations with missing keys, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspan.functions import aggregates as A
from larkspan.functions import math as M
from larkspan.functions import strings as S
from larkspan.functions import temporal as D
from larkspan.operators import crosstab as X
from larkspan.operators import group as G
from larkspan.operators import select
from larkspan.operators import window as W
from larkspan.plans.grouped import GAPS, rounded, table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Events with a value and a key that are missing on some rows, the same on both sides.
KEY = "case when event_id % 11 = 0 then null else event_type end"
_E = f"(select event_id, user_id, ts, value, event_type, {GAPS} as x, {KEY} as k from events)"


def events(spark, sf):
    return table(spark, sf, "events", "event_id", "user_id", "ts", "value", "event_type").withColumns({"x": F.expr(GAPS), "k": F.expr(KEY)})


def parts(spark, sf):
    return table(spark, sf, "part", "p_partkey", "p_size", "p_retailprice", "p_type", "p_name")


@query("select p_partkey, (p_size + p_partkey)::bigint as a, (p_size - p_partkey)::bigint as s, (p_size * p_partkey)::bigint as m, ((p_size - 25) % 7 + 7)::bigint % 7 as modulo, ((p_size - 25) % 7)::bigint as f_mod, floor((p_size - 25) / 7.0)::bigint as fl, round(power(p_size, 1.5), 4) as pw from part")
def arithmetic_family(spark, sf):
    n, k = F.col("p_size").cast("long"), F.col("p_partkey")
    return rounded(parts(spark, sf).select("p_partkey", M.add(n, k).alias("a"), M.sub(n, k).alias("s"), M.mul(n, k).alias("m"), M.mod(n - 25, F.lit(7)).cast("long").alias("modulo"), M.fmod(n - 25, F.lit(7)).cast("long").alias("f_mod"), M.floor_divide(n - 25, F.lit(7)).alias("fl"), M.power(n.cast("double"), 1.5).alias("pw")))


@query("select p_partkey, case when p_size > 25 then round(sqrt(p_size - 25), 6) when p_size = 25 then 0 end as root, case when p_size > 25 then round(ln(p_size - 25), 6) end as l, case when p_size > 25 then round(log2(p_size - 25), 6) end as l2, case when p_size > 25 then round(log10(p_size - 25), 6) end as l10, round(ln(1 + p_size), 6) as l1, round(exp(p_size / 25.0), 6) as e, round(exp(p_size / 25.0) - 1, 6) as em, round(power(2, p_size / 10.0), 6) as e2, (p_size * p_size)::bigint as sq, round(cbrt(p_size), 6) as cb, round(1.0 / nullif(p_size - 25, 0), 6) as rec from part")
def unary_family(spark, sf):
    n = F.col("p_size").cast("long")
    return rounded(parts(spark, sf).select("p_partkey", M.sqrt(n - 25).alias("root"), M.log(n - 25).alias("l"), M.log(n - 25, 2).alias("l2"), M.log(n - 25, 10).alias("l10"), M.log1p(n).alias("l1"), M.exp(n / 25).alias("e"), M.expm1(n / 25).alias("em"), M.exp2(n / 10).alias("e2"), M.square(n).alias("sq"), M.cbrt(n.cast("double")).alias("cb"), M.reciprocal(n - 25).alias("rec")), 6)


@query("select p_partkey, floor(p_retailprice)::bigint as down, ceil(p_retailprice)::bigint as up, trunc(25.5 - p_size)::double as cut, sign(p_size - 25)::double as s, abs(p_size - 25)::bigint as a, (-p_size)::bigint as neg, round(p_retailprice, 1) as r1 from part")
def rounding_family(spark, sf):
    n, c = F.col("p_size").cast("long"), F.col("p_retailprice")
    return parts(spark, sf).select("p_partkey", M.floor(c).alias("down"), M.ceil(c).alias("up"), M.trunc(F.lit(25.5) - n).cast("double").alias("cut"), M.sign(n - 25).alias("s"), M.absolute(n - 25).alias("a"), M.negative(n).alias("neg"), F.round(c, 1).alias("r1"))


@query(f"select event_id, case when x is not null then round(least(x, 50), 4) end as low, case when x is not null then round(greatest(x, 50), 4) end as high, round(least(coalesce(x, 50), 50), 4) as f_low, round(greatest(coalesce(x, 50), 50), 4) as f_high from {_E}")
def least_greatest(spark, sf):
    x, c = F.col("x"), F.lit(50.0)
    return rounded(events(spark, sf).select("event_id", M.minimum(x, c).alias("low"), M.maximum(x, c).alias("high"), M.fmin(x, c).alias("f_low"), M.fmax(x, c).alias("f_high")))


@query(f"select event_id, coalesce(x = value, false) as eq, coalesce(x <> value, true) as ne, coalesce(x < 50, false) as lt, coalesce(x <= 50, false) as le, coalesce(x > 50, false) as gt, coalesce(x >= 50, false) as ge, coalesce(x < 50, false) and event_id % 2 = 0 as both, coalesce(x < 50, false) or event_id % 2 = 0 as either, coalesce(x < 50, false) <> (event_id % 2 = 0) as one from {_E}")
def comparisons(spark, sf):
    x, c, odd = F.col("x"), F.lit(50.0), F.col("event_id") % 2 == 0
    return events(spark, sf).select("event_id", M.COMPARE["eq"](x, F.col("value")).alias("eq"), M.COMPARE["ne"](x, F.col("value")).alias("ne"), *[M.COMPARE[k](x, c).alias(k) for k in ("lt", "le", "gt", "ge")], *[M.logical(x < 50, odd, how).alias(name) for how, name in (("and", "both"), ("or", "either"), ("xor", "one"))])


@query("select p_partkey, (p_size & 12)::bigint as a, (p_size | 12)::bigint as o, xor(p_size, 12)::bigint as x, (p_size & ~12)::bigint as an, (~p_size & 12)::bigint as na, (p_size::bigint << 3) as l, (p_size::bigint >> 2) as r, (~p_size::bigint) as n from part")
def bitwise_family(spark, sf):
    n, c = F.col("p_size").cast("long"), F.lit(12).cast("long")
    names = {"a": "and", "o": "or", "x": "xor", "an": "andnot", "na": "notand"}
    return parts(spark, sf).select("p_partkey", *[M.BITS[k](n, c).alias(a) for a, k in names.items()], M.BITS["shift_left"](n, 3).alias("l"), M.BITS["shift_right"](n, 2).alias("r"), M.BITS["not"](n).alias("n"))


@query("select event_id, v is null or isnan(v) as missing, coalesce(isinf(v), false) as inf, coalesce(isfinite(v), false) as finite, v is null or isnan(v) or v = 0 as nothing, case when v is null or isnan(v) then 0 when isinf(v) then 9 else round(v, 4) end as zeroed from (select event_id, case event_id % 5 when 0 then null when 1 then 'nan'::double when 2 then 'inf'::double when 3 then 0 else value end as v from events)")
def value_tests(spark, sf):
    v = F.expr("case event_id % 5 when 0 then null when 1 then double('nan') when 2 then double('infinity') when 3 then 0 else value end")
    x = events(spark, sf).select("event_id", v.alias("v"))
    c = F.col("v")
    return x.select("event_id", M.is_missing(c).alias("missing"), M.is_inf(c).alias("inf"), M.is_finite(c).alias("finite"), M.is_missing_or_zero(c).alias("nothing"), F.round(M.to_zero(c, 9.0), 4).alias("zeroed"))


@query(f"select event_id, x is null or k is null as any_missing, x is null and k is null as all_missing from {_E}")
def row_masks(spark, sf):
    x = events(spark, sf)
    return x.select("event_id", select.row_mask(x, lambda c: c.isNull(), ["x", "k"]).alias("any_missing"), select.row_mask(x, lambda c: c.isNull(), ["x", "k"], every=True).alias("all_missing"))


@query(f"select event_type, bool_or(coalesce(x > 95, false)) as some, bool_and(coalesce(x, 1) > 0) as every from {_E} group by 1")
def any_all(spark, sf):
    return events(spark, sf).groupBy("event_type").agg(A.any_(F.col("x") > 95).alias("some"), A.all_(F.col("x") > 0).alias("every"))


@query(f"select k as event_type, event_id, round((x - avg(x) over w) / stddev_samp(x) over w, 6) as z from {_E} window w as (partition by k)")
def zscore_missing_keys(spark, sf):
    return rounded(M.zscore(events(spark, sf), "x", "k", "z").select(F.col("k").alias("event_type"), "event_id", "z"), 6)


@query(f"""with q as (select k, quantile_cont(x, 0.1) as a, quantile_cont(x, 0.9) as b from {_E} group by 1)
select event_id, round(least(greatest(x, a), b), 4) as wins, round(case when x between a and b then x end, 4) as trimmed from {_E} e join q on e.k is not distinct from q.k where x is not null""")
def winsorize_missing_keys(spark, sf):
    x = M.trim_groups(M.winsorize(events(spark, sf), "x", 0.1, 0.9, "k", "wins"), "x", "k", 0.1, 0.9, "trimmed")
    return rounded(x.where("x is not null").select("event_id", "wins", "trimmed"))


@query(f"""with q as (select k, quantile_cont(value, [0, 0.25, 0.5, 0.75, 1]) as e from {_E} group by 1)
select event_id, (greatest(len(list_filter(e, lambda y: y < value)), 1) + 1)::int as bin from {_E} t join q on t.k is not distinct from q.k""")
def cut_groups_missing_keys(spark, sf):
    return X.cut_groups(events(spark, sf), "value", "k", 4).select("event_id", "bin")


@query(f"select b.bin, coalesce(count(e.event_id), 0) as count from (select unnest(range(0, 12)) as bin) b left join (select event_id, floor(x / 10)::bigint as at from {_E} where x is not null) e on b.bin = e.at group by 1")
def bincount(spark, sf):
    return G.bincount(events(spark, sf).withColumn("at", F.floor(F.col("x") / 10)), "at", 12)


@query(f"select event_id, k, round(x, 4) as x from {_E} where k is null")
def get_group_missing(spark, sf):
    return rounded(G.Group(events(spark, sf), "k").get_group(None).select("event_id", "k", "x"))


@query(f"select event_id, coalesce(k in ('click', 'view'), false) as inside, row_number() over (partition by k order by event_id) = 1 as first, row_number() over (partition by k order by event_id desc) = 1 as last from {_E}")
def group_masks(spark, sf):
    g = G.Group(events(spark, sf), "k", order=["event_id"])
    last = G.Group(g.edge_mask("first"), "k", order=["event_id"]).edge_mask("last", last=True)
    return last.select("event_id", g.as_filter("click", "view").alias("inside"), "first", "last")


@query(f"""with h as (select event_id, x, list(x) filter (x is not null) over (partition by user_id order by event_id rows 4 preceding) as v from {_E})
select event_id, case when x is not null and len(v) > 1 then round((len(list_filter(v, lambda y: y < x)) + (len(list_filter(v, lambda y: y = x)) - 1) / 2.0) / (len(v) - 1) * 2 - 1, 6) end as r from h""")
def rolling_rank(spark, sf):
    return rounded(W.rolling_rank(events(spark, sf), "x", "user_id", "event_id", 5, "r").select("event_id", "r"), 6)


@query("select strftime(unnest(generate_series(date '2024-02-26', date '2024-03-08', interval 3 day)), '%Y-%m-%d') as date")
def date_range(spark, sf):
    return D.date_range(spark, "2024-02-26", "2024-03-08", 3).select(F.col("date").cast("string").alias("date"))


@query("""with t as (select event_id, (extract(hour from ts) * 3600 + extract(minute from ts) * 60 + floor(extract(second from ts)))::bigint as s from events)
select event_id, (case when s < 34200 then -1 when s >= 57600 then 13 else (s - 34200) // 1800 end)::int as step,
case when s < 34200 then 'pre' when s >= 57600 then 'post' else lpad(((34200 + (s - 34200) // 1800 * 1800) // 3600)::varchar, 2, '0') || ':' || lpad(((34200 + (s - 34200) // 1800 * 1800) // 60 % 60)::varchar, 2, '0') end as label from t""")
def cut_time_steps(spark, sf):
    at = lambda label: D.cut_steps(F.col("ts"), "30T", "09:30", "16:00", label)
    return events(spark, sf).select("event_id", at(False).alias("step"), at(True).alias("label"))


@query("select event_id, round(value - lag(value) over (order by event_id), 4) as d, round(lag(value, 2) over (order by event_id), 4) as s, round(sum(value) over (order by event_id rows 2 preceding), 4) as r from events where user_id <= 5")
def ungrouped_sequence(spark, sf):
    x = events(spark, sf).where("user_id <= 5")
    o = W.Window.orderBy("event_id")
    x = W.rolling(x, "value", "sum", (), "event_id", 3, "r")
    return rounded(x.select("event_id", (F.col("value") - F.lag("value").over(o)).alias("d"), F.lag("value", 2).over(o).alias("s"), "r"))


@query("select (select bool_and(up) from (select event_id >= lag(event_id) over (order by ts) as up from events)) as sorted")
def is_sorted_by_ranges(spark, sf):
    return select.is_sorted(events(spark, sf), "event_id", "ts")


@query("select p_partkey, case when regexp_matches(p_type, '[ST]') then least(case when strpos(p_type, 'S') > 0 then strpos(p_type, 'S') else 999 end, case when strpos(p_type, 'T') > 0 then strpos(p_type, 'T') else 999 end) - 1 else -1 end::int as at, split_part(p_type, ' ', 1) as head, substr(p_type, 2, 1) as c1, right(p_type, 1) as c_last, p_type || '!' as more from part")
def string_parts(spark, sf):
    c = F.col("p_type")
    return parts(spark, sf).select("p_partkey", S.index_any_of(c, "ST").alias("at"), S.substr_char_stop(c, " ").alias("head"), S.char(c, 1).alias("c1"), S.char(c, -1).alias("c_last"), F.concat(c, F.lit("!")).alias("more"))


@query("select c_custkey, c_nationkey, 7::double as c_acctbal, try_cast(substr(c_name, 10) as bigint) as number, c_mktsegment from customer where c_mktsegment in ('BUILDING', 'MACHINERY')")
def columns_and_labels(spark, sf):
    x = select.label_filter(table(spark, sf, "customer"), ["BUILDING", "MACHINERY"], "c_mktsegment")
    x = select.cast(x.withColumn("number", F.substr("c_name", F.lit(10))), {"number": "long"}).withColumn("c_acctbal", F.lit(7.0))
    return select.unflatten(select.flatten(select.drop_columns(x, names=["c_name"])))


@query("select p_partkey, round((p_size - 10) / nullif(p_size - 30, 0), 4) as p_size, round(p_retailprice / nullif(p_retailprice - 30, 0), 4) as p_retailprice from part")
def table_arithmetic(spark, sf):
    x = parts(spark, sf).select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    less = x.select("p_partkey", (F.col("p_size") - 30).alias("p_size"), (F.col("p_retailprice") - 30).alias("p_retailprice"))
    top = x.withColumn("p_size", F.col("p_size") - 10)
    return rounded(select.arithmetic(top, less, "div", "p_partkey"))


@query("select event_id, round(epoch_us(ts - date_trunc('day', ts)) / 3600000000.0, 6) as hours, round((epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 86400000000.0, 6) as days, strftime(ts, '%Y%m%d')::int as ymd, datediff('day', date '1970-01-01', ts::date)::int as epoch_day from events")
def time_spans(spark, sf):
    ts = F.col("ts")
    return rounded(events(spark, sf).select("event_id", D.in_units(D.since_midnight(ts), "hour").alias("hours"), D.in_units(D.difference(ts, F.lit("2024-01-01").cast("timestamp")), "day").alias("days"), D.part(ts, "yyyymmdd").alias("ymd"), D.days_since_epoch(ts).alias("epoch_day")), 6)


@query(f"select event_type, count(x) as n, round(avg(x), 6) as mean, round(stddev_samp(x), 6) as std, round(min(x), 4) as low, round(quantile_cont(x, 0.5), 6) as mid, round(max(x), 4) as high from {_E} group by 1")
def group_describe(spark, sf):
    x = G.Group(events(spark, sf), "event_type").describe("x")
    return rounded(x.select("event_type", F.col("count").alias("n"), "mean", "std", F.round("min", 4).alias("low"), F.col("p50").alias("mid"), F.round("max", 4).alias("high")), 6)
