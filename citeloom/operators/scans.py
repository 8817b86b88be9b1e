"""Running values over sorted rows, without a task that holds all rows of a key.

Rows are dealt over tasks by ranges of their order and written once. What a part
of a key's rows adds is one row; a window over these rows tells every part what
came before it, and a window within the part does the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

#: Windows over the parts of a key, before a part; and over a part's own rows, up to a row.
BEFORE = (Window.unboundedPreceding, -1)
UPTO = (Window.unboundedPreceding, 0)


def in_order(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``at``, which grows with the order, nulls first, and ``part``, the task that wrote a row; rows that tie may lie in several parts."""
    keys = [*order, "deal"]
    dealt = rows.withColumn("deal", F.rand(7)).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return staged(dealt.drop("deal").withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))


def with_parts(rows: DataFrame, parts: DataFrame, *keys: str) -> DataFrame:
    """Join what is known of a part; a null key meets a null key."""
    told = parts.select(*[F.col(k).alias(f"of_{k}") for k in keys], *[c for c in parts.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]
    return rows.join(told, same).drop(*[f"of_{k}" for k in keys])
