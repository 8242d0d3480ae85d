"""Queries of row-preserving operations in order, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

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


K, O = "user_id", "event_id"
_X = f"(select event_id, user_id, ts, value, event_type, {GAPS} as x from events)"
_W = "(partition by user_id order by event_id"


def events(spark, sf):
    return table(spark, sf, "events", "event_id", "user_id", "ts", "value", "event_type").withColumn("x", F.expr(GAPS))


def ordered(name: str, sql: str, run, digits: int = 6):
    """run(events) -> frame; the result is its event_id and the columns that were added."""
    def f(spark, sf):
        e = events(spark, sf)
        out = run(e)
        return rounded(out.select("event_id", *[c for c in out.columns if c not in e.columns]), digits)

    f.__name__ = name
    Q[name], SQL[name] = f, sql


ordered("rolling_sum", f"select event_id, round(coalesce(sum(x) over {_W} rows 2 preceding), 0), 6) as rolling_sum from {_X}", lambda e: W.rolling(e, "x", "sum", K, O))
ordered("rolling_mean", f"select event_id, round(avg(x) over {_W} rows 4 preceding), 6) as rolling_mean from {_X}", lambda e: W.rolling(e, "x", "mean", K, O, 5))
ordered("rolling_strict_mean", f"select event_id, case when count(x) over {_W} rows 2 preceding) = count(*) over {_W} rows 2 preceding) then round(avg(x) over {_W} rows 2 preceding), 6) end as rolling_mean from {_X}", lambda e: W.rolling(e, "x", "mean", K, O, strict=True))
ordered("rolling_std", f"select event_id, round(stddev_samp(x) over {_W} rows 4 preceding), 6) as rolling_std from {_X}", lambda e: W.rolling(e, "x", "std", K, O, 5))
ordered("rolling_minmax", f"select event_id, round(min(x) over {_W} rows 3 preceding), 6) as rolling_min, round(max(x) over {_W} rows 3 preceding), 6) as rolling_max from {_X}", lambda e: W.rolling(W.rolling(e, "x", "min", K, O, 4), "x", "max", K, O, 4))
ordered("rolling_full", f"select event_id, case when count(x) over {_W} rows 2 preceding) = 3 then round(sum(x) over {_W} rows 2 preceding), 6) end as rolling_sum from {_X}", lambda e: W.rolling(e, "x", "sum", K, O, min_count=3))
ordered("rolling_median", f"select event_id, round(median(x) over {_W} rows 4 preceding), 6) as rolling_median from {_X}", lambda e: W.rolling(e, "x", "median", K, O, 5))
ordered("rolling_quantile", f"with l as (select event_id, list_sort(list(x) filter (where x is not null) over {_W} rows 4 preceding)) as s from {_X}) select event_id, round((s[(floor(.3 * (len(s) - 1)) + 1)::int] + s[(ceil(.3 * (len(s) - 1)) + 1)::int]) / 2, 6) as x_q0_3 from l", lambda e: W.rolling_quantile(e, "x", 0.3, K, O, 5))
ordered("cumsum", f"select event_id, round(coalesce(sum(x) over {_W} rows unbounded preceding), 0), 6) as cumsum from {_X}", lambda e: W.cumulate(e, "x", "sum", K, O))
ordered("cumsum_filter", f"select event_id, round(coalesce(sum(case when event_type = 'click' then value end) over {_W} rows unbounded preceding), 0), 6) as cumsum from {_X}", lambda e: W.cumulate(e, "value", "sum", K, O, keep=F.col("event_type") == "click"))
ordered("cumsum_reset", f"with p as (select *, sum((event_type = 'purchase')::int) over {_W} rows unbounded preceding) as part from {_X}) select event_id, round(sum(value) over (partition by user_id, part order by event_id rows unbounded preceding), 6) as cumsum from p", lambda e: W.cumulate(e, "value", "sum", K, O, reset=F.col("event_type") == "purchase"))
ordered("cumprod", f"select event_id, round(exp(sum(ln(1 + value / 1e6)) over {_W} rows unbounded preceding)), 6) as cumprod from {_X}", lambda e: W.cumulate(e.withColumn("value", 1 + F.col("value") / 1e6), "value", "prod", K, O))
ordered("cummax", f"select event_id, max(x) over {_W} rows unbounded preceding) as cummax, case when count(*) over {_W} rows unbounded preceding) = count(x) over {_W} rows unbounded preceding) then min(x) over {_W} rows unbounded preceding) end as cummin from {_X}", lambda e: W.cumulate(W.cumulate(e, "x", "max", K, O), "x", "min", K, O, skipna=False))
ordered("cumcount", f"select event_id, row_number() over {_W}) - 1 as cumcount from {_X}", lambda e: W.cumulate(e, "x", "count", K, O))
ordered("cumcount_filter", f"select event_id, case when event_type = 'click' then (sum((event_type = 'click')::int) over {_W} rows unbounded preceding) - 1)::bigint end as cumcount from {_X}", lambda e: W.cumulate(e, "x", "count", K, O, keep=F.col("event_type") == "click"))
ordered("find_nth", f"select event_id, case when event_type = 'click' then (sum((event_type = 'click')::int) over {_W} rows unbounded preceding))::bigint else 0 end as nth from {_X}", lambda e: W.find_nth(e, F.col("event_type") == "click", K, O))
ordered("shift", f"select event_id, lag(value, 2) over {_W}) as shifted, lead(value) over {_W}) as ahead from {_X}", lambda e: W.shift(W.shift(e, "value", K, O, 2), "value", K, O, -1, name="ahead"))
ordered("shift_filter", f"select event_id, case when event_type = 'click' then lag(value) over (partition by user_id, event_type = 'click' order by event_id) end as shifted from {_X}", lambda e: W.shift(e, "value", K, O, keep=F.col("event_type") == "click"))
ordered("diff", f"select event_id, round(value - lag(value) over {_W}), 6) as diff from {_X}", lambda e: W.diff(e, "value", K, O))
ordered("differs", f"select event_id, case when row_number() over {_W}) = 1 then false else event_type is distinct from lag(event_type) over {_W}) end as differs from {_X}", lambda e: W.differs(e, "event_type", K, O))
ordered("fill_forward", f"select event_id, last_value(x ignore nulls) over {_W} rows unbounded preceding) as filled from {_X}", lambda e: W.fill(e, "x", K, O, name="filled"))
ordered("fill_backward", f"select event_id, first_value(x ignore nulls) over {_W} rows between current row and unbounded following) as filled from {_X}", lambda e: W.fill(e, "x", K, O, False, name="filled"))
ordered("fill_limit", f"select event_id, case when last_value(x ignore nulls) over {_W} rows unbounded preceding) is null then -1 else last_value(x ignore nulls) over {_W} rows 1 preceding) end as filled from {_X}", lambda e: W.fill(e, "x", K, O, limit=1, value=-1.0, name="filled"))
ordered("time_window_sum", f"select event_id, round(sum(value) over (partition by user_id order by ts range interval 6 hours preceding), 6) as \"window\" from {_X}", lambda e: W.time_window(e, "value", K, F.unix_micros("ts"), 6 * 3600 * 1_000_000))
ordered("ema_decay", f"select a.event_id, round(sum(coalesce(b.x, 0) * exp(-.0001 * (epoch_us(a.ts) - epoch_us(b.ts)) / 1e6)), 6) as ema from {_X} a join {_X} b on a.user_id = b.user_id and b.event_id <= a.event_id group by a.event_id", lambda e: W.ema(e.withColumn("seconds", F.unix_micros("ts") / 1e6), "x", K, O, 1e-4, time="seconds").drop("seconds"))
ordered("ema_weighted", f"with recursive n as (select event_id, user_id, value, row_number() over {_W}) as r from {_X}), e as (select event_id, user_id, r, value as ema from n where r = 1 union all select n.event_id, n.user_id, n.r, n.value * .5 + e.ema * .5 from e join n on n.user_id = e.user_id and n.r = e.r + 1) select event_id, round(ema, 6) as ema from e", lambda e: W.ema(e, "value", K, O, 0.5, "weighted"))
ordered("ema_normal", f"with recursive n as (select event_id, user_id, value, epoch_us(ts) / 1e6 as t, row_number() over {_W}) as r from {_X}), e as (select event_id, user_id, r, t, value as ema from n where r = 1 union all select n.event_id, n.user_id, n.r, n.t, n.value * (1 - exp(-.0001 * (n.t - e.t))) + e.ema * exp(-.0001 * (n.t - e.t)) from e join n on n.user_id = e.user_id and n.r = e.r + 1) select event_id, round(ema, 6) as ema from e", lambda e: W.ema(e.withColumn("seconds", F.unix_micros("ts") / 1e6), "value", K, O, 1e-4, "normal", time="seconds").drop("seconds"))
ordered("rolling_argmin", f"with r as (select event_id, user_id, value, row_number() over {_W}) as r from {_X}) select a.event_id, (a.r - arg_min(b.r, struct_pack(v := b.value, r := -b.r)))::bigint as arg from r a join r b on a.user_id = b.user_id and b.r between a.r - 4 and a.r group by a.event_id, a.r", lambda e: W.rolling_arg(e, "value", K, O, 5).withColumn("arg", F.col("arg").cast("long")))
ordered("prefix_sum", f"select event_id, round(sum(value) over (order by event_id), 4) as cumsum from {_X}", lambda e: W.prefix_sum(e, "value", O, F.floor(F.col(O) / 1000)), 4)
