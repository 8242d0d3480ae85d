"""Queries of joins, as-of joins and membership, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspan.operators import joins, stack
from larkspan.plans.grouped import table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Every fifth key of orders and every third of customers is missing, the same in the SQL; so both sides have rows without a match.
KEY, CUSTOMER = "case when o_orderkey % 5 = 0 then null else o_custkey end", "case when c_custkey % 3 = 0 then null else c_custkey end"


def sides(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_totalprice").select("o_orderkey", F.expr(KEY).alias("k"), "o_totalprice")
    c = table(spark, sf, "customer", "c_custkey", "c_acctbal", "c_mktsegment").withColumn("c_custkey", F.expr(CUSTOMER)).withColumnRenamed("c_custkey", "k")
    return o, c


_O = f"(select o_orderkey, {KEY} as k, o_totalprice from orders)"
_C = f"(select {CUSTOMER} as k, c_acctbal, c_mktsegment from customer)"
for _how, _join in (("inner", "join"), ("left", "left join"), ("right", "right join"), ("outer", "full join")):
    def _merge(spark, sf, how=_how):
        return joins.merge(*sides(spark, sf), "k", how, indicator="side")

    Q[f"merge_{_how}"] = _merge
    SQL[f"merge_{_how}"] = f"select o_orderkey, coalesce(o.k, c.k) as k, o_totalprice, c_acctbal, c_mktsegment, case when o.i is null then 'right_only' when c.i is null then 'left_only' else 'both' end as side from (select *, 1 as i from {_O}) o {_join} (select *, 1 as i from {_C}) c on o.k = c.k"
for _keep in ("first", "last"):
    def _kept(spark, sf, keep=_keep):
        o, c = sides(spark, sf)
        return joins.merge(c, o, "k", "left", keep=(None, keep), order=(None, "o_orderkey"))

    Q[f"merge_keep_{_keep}"] = _kept
    SQL[f"merge_keep_{_keep}"] = f"select c.k, c_acctbal, c_mktsegment, o_orderkey, o_totalprice from {_C} c left join (select distinct on (k) * from {_O} order by k, o_orderkey {'desc' if _keep == 'last' else ''}) o on c.k = o.k"


@query("select l_orderkey, l_partkey, round(l_tax, 4) as l_tax, p_brand, s_name from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey")
def lookup_require(spark, sf):
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_tax")
    x = joins.lookup(lines, table(spark, sf, "part", "p_partkey", "p_brand"), [("l_partkey", "p_partkey")], require_match=True)
    x = joins.lookup(x, table(spark, sf, "supplier", "s_suppkey", "s_name"), [("l_suppkey", "s_suppkey")], require_match=True)
    return x.select("l_orderkey", "l_partkey", F.round("l_tax", 4).alias("l_tax"), "p_brand", "s_name")


@query("select c_custkey, c_nationkey, o_orderkey as first_order from customer left join (select distinct on (o_custkey) * from orders order by o_custkey, o_orderkey) on c_custkey = o_custkey")
def merge_first(spark, sf):
    c = table(spark, sf, "customer", "c_custkey", "c_nationkey")
    o = table(spark, sf, "orders", "o_custkey", "o_orderkey").toDF("c_custkey", "first_order")
    return joins.merge_first(c, o, "c_custkey", "first_order")


@query("select l_orderkey, l_linenumber, o_orderstatus as sides from lineitem join orders on l_orderkey = o_orderkey")
def merge_validated(spark, sf):
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber")
    orders = table(spark, sf, "orders", "o_orderkey", "o_orderstatus").toDF("l_orderkey", "sides")
    return joins.merge(lines, orders, "l_orderkey", "inner", validate="m:1")


_A = "(select * from events where event_type = 'purchase')"
_B = "(select * from events where event_type = 'click')"


def halves(spark, sf):
    e = table(spark, sf, "events", "event_id", "ts", "user_id", "event_type", "value")
    return e.where("event_type = 'purchase'").select("event_id", "ts", "user_id"), e.where("event_type = 'click'").select(F.col("event_id").alias("hit"), "ts", "user_id", F.col("value").alias("hit_value"))


def _asof(direction: str, **how):
    def run(spark, sf):
        a, b = halves(spark, sf)
        return joins.asof(a, b, "ts", "user_id", direction, order_right="hit", **how).select("event_id", "user_id", "hit", "hit_value")

    return run


def _asof_sql(back: str, forward: str | None = None, more: str = "") -> str:
    pick = lambda op, by: f"(select struct_pack(i := b.event_id, v := b.value, t := b.ts) from {_B} b where b.user_id = a.user_id and b.ts {op} a.ts order by {by} limit 1)"
    if forward is None:
        op, by = (back, "b.ts desc, b.event_id desc") if back[0] == "<" else (back, "b.ts, b.event_id")
        return f"with x as (select event_id, user_id, ts, {pick(op, by)} as m from {_A} a) select event_id, user_id, case when {more or 'true'} then m.i end as hit, case when {more or 'true'} then m.v end as hit_value from x"
    return f"with x as (select event_id, user_id, ts, {pick('<=', 'b.ts desc, b.event_id desc')} as p, {pick('>=', 'b.ts, b.event_id')} as f from {_A} a), y as (select *, case when f is null or (p is not null and epoch_us(ts) - epoch_us(p.t) <= epoch_us(f.t) - epoch_us(ts)) then p else f end as m from x) select event_id, user_id, m.i as hit, m.v as hit_value from y"


Q |= {"asof_backward": _asof("backward"), "asof_backward_strict": _asof("backward", exact=False), "asof_forward": _asof("forward"), "asof_nearest": _asof("nearest"), "asof_tolerance": _asof("backward", tolerance=86400)}
SQL |= {"asof_backward": _asof_sql("<="), "asof_backward_strict": _asof_sql("<"), "asof_forward": _asof_sql(">="), "asof_nearest": _asof_sql("", ""), "asof_tolerance": _asof_sql("<=", more="epoch_us(ts) - epoch_us(m.t) <= 86400000000")}


@query("select c_custkey, exists(select 1 from orders where o_custkey = c_custkey) as member, (select min(o_orderkey) from orders where o_custkey = c_custkey) as at from customer")
def ismember(spark, sf):
    return joins.ismember(table(spark, sf, "customer", "c_custkey"), table(spark, sf, "orders", "o_custkey", "o_orderkey"), [("c_custkey", "o_custkey")], index="at", order="o_orderkey")


@query("select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders)")
def not_in(spark, sf):
    return joins.isin(table(spark, sf, "customer", "c_custkey", "c_name"), table(spark, sf, "orders", "o_custkey"), [("c_custkey", "o_custkey")], negate=True)


@query("select c_custkey, coalesce((select arg_min(o_orderpriority, o_orderkey) from orders where o_custkey = c_custkey), 'none') as priority from customer")
def take_first(spark, sf):
    return joins.take_first(table(spark, sf, "customer", "c_custkey"), table(spark, sf, "orders", "o_custkey", "o_orderkey", "o_orderpriority"), [("c_custkey", "o_custkey")], "o_orderpriority", "o_orderkey", "none", "priority")


@query("select c_custkey, (c_acctbal > 0)::int + (c_acctbal > 2500)::int + (c_acctbal > 5000)::int as at from customer")
def searchsorted(spark, sf):
    return table(spark, sf, "customer", "c_custkey", "c_acctbal").select("c_custkey", joins.searchsorted(F.col("c_acctbal"), [0.0, 2500.0, 5000.0]).alias("at"))


@query("select s_name as name, s_acctbal as bal, null::varchar as seg, 'supplier' as origin from supplier union all select c_name, c_acctbal, c_mktsegment, 'customer' from customer")
def concat_rows(spark, sf):
    s = table(spark, sf, "supplier", "s_name", "s_acctbal").toDF("name", "bal")
    c = table(spark, sf, "customer", "c_name", "c_acctbal", "c_mktsegment").toDF("name", "bal", "seg")
    return stack.concat_rows(s, c, source="origin", names=["supplier", "customer"])


@query("select o_orderkey, o_totalprice, o_orderpriority from orders")
def concat_columns(spark, sf):
    return stack.concat_columns([table(spark, sf, "orders", "o_orderkey", "o_totalprice"), table(spark, sf, "orders", "o_orderkey", "o_orderpriority")], "o_orderkey")
