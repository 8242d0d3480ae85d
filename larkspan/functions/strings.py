"""String expressions; positions count from 0 and are -1 where nothing is found."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

upper, lower, reverse, length = F.upper, F.lower, F.reverse, F.char_length


def index(c: Column, s: str) -> Column:
    return F.instr(c, s) - 1


def index_any_of(c: Column, chars: str) -> Column:
    return F.regexp_instr(c, F.lit("[" + re.sub(r"([\[\]\\^&-])", r"\\\1", chars) + "]")) - 1


def contains(c: Column, s: str) -> Column:
    return c.contains(s)


def replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def regex_match(c: Column, pattern: str) -> Column:
    return c.rlike(pattern)


def regex_replace(c: Column, pattern: str, to: str) -> Column:
    """Groups in `to` as \\1."""
    return F.regexp_replace(c, pattern, re.sub(r"\\(\d)", r"$\1", to))


def extract(c: Column, pattern: str, names: list[str]) -> list[Column]:
    """A column a group, empty on a miss."""
    return [F.regexp_extract(c, pattern, i + 1).alias(n) for i, n in enumerate(names)]


def substr(c: Column, start: int, stop: int | None = None) -> Column:
    """Slice [start:stop], negative from the end."""
    n = F.char_length(c)
    at = lambda k: F.least(n, F.greatest(F.lit(0), n + k if k < 0 else F.lit(k)))
    a, b = at(start), n if stop is None else at(stop)
    return F.substring(c, a + 1, F.greatest(F.lit(0), b - a))


def substr_char_stop(c: Column, stop: str) -> Column:
    """Up to the first `stop`, or the whole."""
    return F.substring_index(c, stop, 1)


def char(c: Column, k: int) -> Column:
    return substr(c, k, k + 1 if k != -1 else None)


def strip_trailing(c: Column, chars: str = " ") -> Column:
    return F.rtrim(c, F.lit(chars))


def join_keys(*columns: Column) -> Column:
    """Several keys as one text, joined by _."""
    return F.concat_ws("_", *columns)


def relabel(df: DataFrame, column: str, how: dict, default=None, name: str | None = None) -> DataFrame:
    """Values by a dict; others become the default, or stay."""
    pairs = F.create_map(*[F.lit(x) for kv in how.items() for x in kv])
    got = F.try_element_at(pairs, F.col(column))
    return df.withColumn(name or column, F.coalesce(got, F.col(column) if default is None else F.lit(default)))
