"""larkspan: tabular and time-series analytics on Spark DataFrames."""

from larkspan import functions, operators, sources
from larkspan.functions import aggregates, math, stats, strings, temporal
from larkspan.operators import category, crosstab, group, joins, select, stack, window
from larkspan.session import session
from larkspan.sources import tables

__all__ = ["aggregates", "category", "crosstab", "functions", "group", "joins", "math", "operators", "select", "session", "sources", "stack", "stats", "strings", "tables", "temporal", "window"]
