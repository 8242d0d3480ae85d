"""Joins with null-safe rules, key checks and first or last matching; as-of joins; membership.

Missing keys match nothing; a key of several columns is missing if one of them is. Empty strings are values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A lookup table is broadcast up to so many rows, counted before.
SMALL = 100_000


def _pairs(on) -> list[tuple[str, str]]:
    on = [on] if isinstance(on, (str, tuple)) else list(on)
    return [(x, x) if isinstance(x, str) else x for x in on]


def _one(df: DataFrame, keys: list[str], keep: str, order) -> DataFrame:
    """The first or last row of each key; missing keys form one group."""
    by = [order] if isinstance(order, (str, Column)) else list(order)
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) if keep == "last" else c for c in by])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def has_duplicates(df: DataFrame, keys: list[str]) -> bool:
    """Whether a complete key is there twice; stops at the first."""
    whole = df.dropna(subset=keys)
    return bool(whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count())


def merge(left: DataFrame, right: DataFrame, on, how: str = "left", keep=None, order=(None, None), suffixes: tuple[str, str] | None = None, indicator: str | None = None, validate: str | None = None, columns_left: list[str] | None = None, columns_right: list[str] | None = None) -> DataFrame:
    """All matching pairs of rows. how: left, right, inner, outer.

    on: names, or (left, right) pairs. keep: (left, right), each None, first or last by `order` of that side. validate: 1:1, 1:m, m:1 or m:m. Names of both sides
    that are no keys need suffixes. A key named alike on both sides is one column, taken from the side that has it; keys named
    differently both stay. indicator: a column of left_only, right_only or both.
    """
    pairs = _pairs(on)
    lk, rk = [a for a, _ in pairs], [b for _, b in pairs]
    for side, df, keys in (("left", left, lk), ("right", right, rk)):
        if missing := set(keys) - set(df.columns):
            raise ValueError(f"no such {side} columns: {sorted(missing)}")
    keep = keep if isinstance(keep, (tuple, list)) else (None, keep)
    if keep[0] and how == "outer":
        raise ValueError("keep of the left side can't be had in an outer join")
    if columns_left:
        left = left.select(*dict.fromkeys([*lk, *columns_left]))
    shared = {a for a, b in pairs if a == b}
    if columns_right:
        right_order = [order[1]] if isinstance(order[1], str) else list(order[1] or [])
        right = right.select(*dict.fromkeys([*rk, *columns_right, *right_order])) if keep[1] else right.select(*dict.fromkeys([*rk, *columns_right]))
    if keep[0]:
        left = _one(left, lk, keep[0], order[0])
    if keep[1]:
        right = _one(right, rk, keep[1], order[1])
    if validate:
        for df, keys, one in ((left, lk, validate[0] == "1"), (right, rk, validate[-1] == "1")):
            if one and has_duplicates(df, keys):
                raise ValueError(f"keys {keys} aren't unique, as {validate} asks")
    clash = (set(left.columns) & set(right.columns)) - shared
    if clash and not suffixes:
        raise ValueError(f"both sides have {sorted(clash)}: give suffixes")
    l, r = left.withColumn("_in_l", F.lit(True)), right.withColumn("_in_r", F.lit(True))
    l = l.toDF(*[f"l_{c}" for c in l.columns])
    r = r.toDF(*[f"r_{c}" for c in r.columns])
    cond = [F.col(f"l_{a}") == F.col(f"r_{b}") for a, b in pairs]
    x = l.join(r, cond, {"outer": "full_outer"}.get(how, how))
    out = []
    for c in left.columns:
        v = F.col(f"l_{c}")
        if c in shared:
            v = F.coalesce(v, F.col(f"r_{c}"))
        out.append(v.alias(c + suffixes[0] if c in clash else c))
    out += [F.col(f"r_{c}").alias(c + suffixes[1] if c in clash else c) for c in right.columns if c not in shared]
    if indicator:
        out.append(F.when(F.col("l__in_l").isNull(), "right_only").when(F.col("r__in_r").isNull(), "left_only").otherwise("both").alias(indicator))
    return x.select(*out)


def lookup(left: DataFrame, right: DataFrame, on, columns: list[str] | None = None, keep: str | None = None, order=None, require_match: bool = False, suffix: str | None = None) -> DataFrame:
    """Every left row once, with the right row of its key. Right keys must be unique unless keep is first or last; require_match raises on misses.

    The right side is broadcast only if a count finds it small.
    """
    pairs = _pairs(on)
    rk = [b for _, b in pairs]
    if keep is None and has_duplicates(right, rk):
        raise ValueError(f"right keys {rk} aren't unique: give keep")
    own = [c for c in (columns or right.columns) if c not in rk]
    r = _one(right, rk, keep, order) if keep else right
    r = r.select(*rk, *own)
    if r.limit(SMALL + 1).count() <= SMALL:
        r = F.broadcast(r)
    if require_match:
        keys = r.toDF(*[f"_{c}" for c in r.columns])
        if left.join(keys, [F.col(a) == F.col(f"_{b}") for a, b in pairs], "left_anti").limit(1).count():
            raise ValueError("some left rows have no match")
    return merge(left, r, on, "left", suffixes=("", suffix) if suffix else None)


def merge_first(left: DataFrame, right: DataFrame, on, order, how: str = "left", suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """The older join: only the first match of a left row; how is left or inner."""
    return merge(left, right, on, how, keep=(None, "first"), order=(None, order), suffixes=suffixes)


def asof(left: DataFrame, right: DataFrame, on, by=(), direction: str = "backward", exact: bool = True, tolerance=None, order_right=None, suffix: str = "_y", matched_on: str | None = None) -> DataFrame:
    """Every left row with the right row of the nearest `on` in the direction (backward, forward, nearest) among rows with equal `by`.

    Ties: backward takes the last right row by order_right, forward the first; nearest prefers backward at equal distance. exact: whether equal `on` match.
    tolerance: greatest distance (numbers; seconds for timestamps). Missing on or by match nothing. Both sides are put in one sorted
    sequence a key, so one shuffle does; the right row travels as one struct.
    """
    (lo, ro), = _pairs(on)
    by = _pairs(by) if by else []
    keys = [f"_k{i}" for i in range(len(by))]
    rest = [c for c in right.columns if c not in {b for _, b in by}]
    tie = F.col(order_right) if isinstance(order_right, str) else order_right if order_right is not None else F.lit(0)
    kind = dict(right.dtypes)[ro]
    r = right.where(F.col(ro).isNotNull()).select(*[F.col(b).alias(k) for (_, b), k in zip(by, keys, strict=True)], F.col(ro).alias("_on"), tie.alias("_tie"), F.struct(*rest).alias("_r"), F.lit(None).cast(left.schema.simpleString()).alias("_l"))
    l = left.select(*[F.col(a).alias(k) for (a, _), k in zip(by, keys, strict=True)], F.col(lo).cast(kind).alias("_on"), F.lit(None).cast(r.schema["_tie"].dataType).alias("_tie"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.struct(*left.columns).alias("_l"))
    both = r.unionByName(l).withColumn("_m", F.when(F.col("_r").isNotNull(), F.struct(F.col("_on").alias("o"), F.col("_r").alias("r"))))
    is_left = F.col("_l").isNotNull().cast("int")

    def pick(back: bool) -> Column:
        # backward: right rows of equal time stand before the left row if they may match
        rank = (is_left if exact else -is_left) if back else (-is_left if exact else is_left)
        w = Window.partitionBy(*keys).orderBy(F.col("_on").asc_nulls_first(), rank, F.col("_tie"))
        return F.last("_m", True).over(w.rowsBetween(Window.unboundedPreceding, 0)) if back else F.first("_m", True).over(w.rowsBetween(0, Window.unboundedFollowing))

    number = lambda c: c.cast("double")
    far = lambda m: F.abs(number(F.col("_on")) - number(m["o"]))
    made = {}
    if direction in ("backward", "nearest"):
        made["_b"] = pick(True)
    if direction in ("forward", "nearest"):
        made["_f"] = pick(False)
    x = both.withColumns(made).where("_l is not null")
    if direction == "nearest":
        b, f = F.col("_b"), F.col("_f")
        m = F.when(f.isNull() | (far(b) <= far(f)), b).otherwise(f)
    else:
        m = F.col("_b" if direction == "backward" else "_f")
    good = F.col("_on").isNotNull()
    for k in keys:
        good = good & F.col(k).isNotNull()
    if tolerance is not None:
        good = good & (far(m) <= F.lit(float(tolerance)))
    x = x.withColumn("_hit", F.when(good, m))
    out = [F.col("_l")[c].alias(c) for c in left.columns]
    out += [F.col("_hit")["r"][c].alias(c + suffix if c in left.columns else c) for c in rest if not (c == ro and lo == ro)]
    if matched_on:
        out.append(F.col("_hit")["o"].alias(matched_on))
    return x.select(*out)


def ismember(left: DataFrame, right: DataFrame, on, name: str = "member", index: str | None = None, order=None) -> DataFrame:
    """left with a flag for keys that right has, and, if index is a name, the least `order` of right's rows with that key."""
    pairs = _pairs(on)
    r = right.groupBy(*[F.col(b).alias(f"_k{i}") for i, (_, b) in enumerate(pairs)]).agg((F.min(order) if index else F.lit(1)).alias("_first"))
    x = left.join(r, [F.col(a) == F.col(f"_k{i}") for i, (a, _) in enumerate(pairs)], "left")
    more = [F.col("_k0").isNotNull().alias(name)] + ([F.col("_first").alias(index)] if index else [])
    return x.select(*left.columns, *more)


def isin(left: DataFrame, right: DataFrame, on, negate: bool = False) -> DataFrame:
    """Rows whose key right has, or has not; each once."""
    pairs = _pairs(on)
    r = right.select(*[F.col(b).alias(f"_k{i}") for i, (_, b) in enumerate(pairs)])
    return left.join(r, [F.col(a) == F.col(f"_k{i}") for i, (a, _) in enumerate(pairs)], "left_anti" if negate else "left_semi")


def take_first(left: DataFrame, right: DataFrame, on, column: str, order, default=None, name: str | None = None) -> DataFrame:
    """The value of the first right row with the key, or the default."""
    pairs = _pairs(on)
    r = right.groupBy(*[F.col(b).alias(f"_k{i}") for i, (_, b) in enumerate(pairs)]).agg(F.min_by(column, order).alias("_v"), F.lit(True).alias("_hit"))
    x = left.join(r, [F.col(a) == F.col(f"_k{i}") for i, (a, _) in enumerate(pairs)], "left")
    value = F.col("_v") if default is None else F.when(F.col("_hit"), F.col("_v")).otherwise(F.lit(default))
    return x.select(*left.columns, value.alias(name or column))


def searchsorted(c: Column, edges: list, right: bool = False) -> Column:
    """Where c would be inserted in the sorted edges: before equal ones, or after them."""
    at = F.lit(0)
    for e in edges:
        at = at + F.when((F.lit(e) <= c) if right else (F.lit(e) < c), 1).otherwise(0)
    return at
