"""Dates, times and spans. Stored times are UTC; parts are those of a zone. Spans are nanoseconds as doubles. Monday is weekday 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Nanoseconds of a unit. Fixed values.
UNITS = {"day": 86_400_000_000_000, "hour": 3_600_000_000_000, "minute": 60_000_000_000, "second": 1_000_000_000, "millisecond": 1_000_000, "microsecond": 1_000, "nanosecond": 1}
#: Letters of resampling rules. Fixed values.
RULES = {"D": "day", "H": "hour", "T": "minute", "S": "second", "L": "millisecond", "U": "microsecond", "N": "nanosecond"}
#: strftime codes as date_format letters. Fixed values.
CODES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%y": "yy", "%j": "DDD", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%p": "a", "%I": "hh"}


def local(ts: Column, zone: str = "UTC") -> Column:
    return ts if zone == "UTC" else F.from_utc_timestamp(ts, zone)


def nanos(ts: Column) -> Column:
    return F.unix_micros(ts) * 1000


def part(ts: Column, what: str, zone: str = "UTC") -> Column:
    """year, quarter, month, day_of_month, day_of_year, day_of_week, week, is_weekend, is_leapyear, month_start, month_end, week_start, year_week, date."""
    t = local(ts, zone)
    return {
        "year": lambda: F.year(t), "quarter": lambda: F.quarter(t), "month": lambda: F.month(t), "day_of_month": lambda: F.dayofmonth(t), "day_of_year": lambda: F.dayofyear(t), "day_of_week": lambda: F.weekday(t), "week": lambda: F.weekofyear(t),
        "is_weekend": lambda: F.weekday(t) >= 5, "is_weekday": lambda: F.weekday(t) < 5, "is_leapyear": lambda: F.dayofyear(F.make_date(F.year(t), F.lit(12), F.lit(31))) == 366, "month_start": lambda: F.trunc(t, "month"), "month_end": lambda: F.last_day(t),
        "week_start": lambda: F.trunc(t, "week"), "yyyymmdd": lambda: F.date_format(t, "yyyyMMdd").cast("int"), "date": lambda: F.to_date(t),
    }[what]()


def since_midnight(ts: Column, zone: str = "UTC") -> Column:
    """Nanoseconds since the zone's midnight."""
    return F.pmod(F.unix_micros(local(ts, zone)), F.lit(86_400_000_000)) * 1000


def fraction(ts: Column, unit: str, zone: str = "UTC") -> Column:
    """hour, minute, second, millisecond or microsecond inside the next larger unit, with its fraction; day: the fraction of the day."""
    order = list(UNITS)
    n = since_midnight(ts, zone).cast("double")
    if unit == "day":
        return n / UNITS["day"]
    whole = UNITS[order[order.index(unit) - 1]]
    return F.pmod(n, F.lit(float(whole))) / UNITS[unit]


def span(n: float | Column, unit: str) -> Column:
    return (n if isinstance(n, Column) else F.lit(float(n))) * float(UNITS[unit])


def in_units(nanoseconds: Column, unit: str) -> Column:
    return nanoseconds.cast("double") / UNITS[unit]


def difference(a: Column, b: Column) -> Column:
    """a - b in nanoseconds."""
    return (F.unix_micros(a) - F.unix_micros(b)).cast("double") * 1000


def shift(ts: Column, nanoseconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + F.floor(nanoseconds / 1000))


def days_since_epoch(d: Column) -> Column:
    return F.unix_date(d.cast("date"))


def offset(ts: Column, zone: str) -> Column:
    """Hours that the zone is ahead of UTC."""
    return (F.unix_micros(F.from_utc_timestamp(ts, zone)) - F.unix_micros(ts)) / 3_600_000_000


def is_dst(ts: Column, zone: str) -> Column:
    """Whether the offset is above the year's least."""
    y = F.year(ts)
    at = lambda m: offset(F.make_timestamp(y, F.lit(m), F.lit(1), F.lit(12), F.lit(0), F.lit(0)), zone)
    return offset(ts, zone) > F.least(at(1), at(7))


def to_utc(ts: Column, zone: str) -> Column:
    return F.to_utc_timestamp(ts, zone)


def parse(text: Column, pattern: str, zone: str = "UTC") -> Column:
    """strptime pattern; missing where it does not fit."""
    t = F.try_to_timestamp(text, F.lit(_pattern(pattern)))
    return t if zone == "UTC" else F.to_utc_timestamp(t, zone)


def strftime(ts: Column, pattern: str, zone: str = "UTC") -> Column:
    return F.date_format(local(ts, zone), _pattern(pattern))


def _pattern(p: str) -> str:
    for code, letters in CODES.items():
        p = p.replace(code, letters)
    return p


def rule_nanos(rule: str) -> int:
    """5T is five minutes."""
    n = rule[:-1]
    return (int(n) if n else 1) * UNITS[RULES[rule[-1].upper()]]


def floor_to(ts: Column, rule: str) -> Column:
    """The start of the rule's step since the epoch."""
    step = rule_nanos(rule) // 1000
    return F.timestamp_micros(F.unix_micros(ts) - F.pmod(F.unix_micros(ts), F.lit(step)))


def regular(df: DataFrame, ts: str, rule: str, name: str = "ts") -> DataFrame:
    """Every step from the first time to the last, one row each."""
    step = rule_nanos(rule) // 1000
    ends = df.agg(F.min(F.unix_micros(floor_to(F.col(ts), rule))).alias("a"), F.max(F.unix_micros(floor_to(F.col(ts), rule))).alias("b")).where("a is not null")
    return ends.select(F.explode(F.sequence("a", "b", F.lit(step))).alias("m")).select(F.timestamp_micros("m").alias(name))


def cut_time(ts: Column, edges: list[str], zone: str = "UTC") -> Column:
    """Time of day between edges HH:MM[:SS]: 0 before the first, len(edges) from the last on."""
    n = since_midnight(ts, zone)
    out = F.lit(0)
    for i, e in enumerate(edges):
        h, m, *s = (int(x) for x in e.split(":"))
        out = F.when(n >= ((h * 60 + m) * 60 + (s[0] if s else 0)) * UNITS["second"], i + 1).otherwise(out)
    return out


def from_day_number(c: Column) -> Column:
    """Days since year 0 with a fraction to a timestamp."""
    return F.timestamp_micros(F.round((c - 719_529) * 86_400_000_000).cast("long"))


def date_range(spark, start: str, end: str, step: int = 1, closed: str = "both", name: str = "date") -> DataFrame:
    """Days from start to end, each `step` days; closed: both, left (without the end) or right (without the start)."""
    out = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.make_interval(days=F.lit(step)))).alias(name))
    if closed == "left":
        out = out.where(F.col(name) != F.to_date(F.lit(end)))
    return out.where(F.col(name) != F.to_date(F.lit(start))) if closed == "right" else out


def cut_steps(ts: Column, step: str, start: str | None = None, stop: str | None = None, label: bool = False, zone: str = "UTC") -> Column:
    """Steps of a rule (30T) from start to stop (HH:MM): numbers from 0, -1 before start, one more than the last from stop on; or labels pre, HH:MM, post."""
    seconds = lambda t, other: other if t is None else (int(t.split(":")[0]) * 60 + int(t.split(":")[1])) * 60
    a, b, n = seconds(start, 0), seconds(stop, 86_400), rule_nanos(step) // UNITS["second"]
    at = F.floor(since_midnight(ts, zone) / UNITS["second"])
    number = F.when(at < a, -1).when(at >= b, -(-(b - a) // n)).otherwise(F.floor((at - a) / n)).cast("int")
    if not label:
        return number
    begins = F.lit(a) + number * n
    clock = F.concat(F.lpad(F.floor(begins / 3600).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.floor(begins / 60) % 60).cast("string"), 2, "0"))
    return F.when(at < a, "pre").when(at >= b, "post").otherwise(clock)
