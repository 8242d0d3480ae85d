"""All queries of the engine with their SQL twins."""

from larkspan.plans import grouped, joined, ordered, scalar, shaped

QUERIES: dict = {**grouped.Q, **joined.Q, **ordered.Q, **shaped.Q, **scalar.Q}
SQL: dict = {**grouped.SQL, **joined.SQL, **ordered.SQL, **shaped.SQL, **scalar.SQL}
