"""Chat formatting with collapse of cumulative snapshots.

A log often holds a conversation many times, each time with a few more turns.
Rolling hashes of all turn prefixes find conversations that are a prefix of a
longer one; anti-joins retain the maximal ones, and of equal ones that with the
least id; these are rendered.

A conversation is dealt into blocks of ``BLOCK`` turns. The hash of a prefix is
the exclusive or of its turns' hashes, each taken with its position, so blocks
are hashed apart and then put together: neither a long conversation nor a first
turn that many share comes together in one task. A conversation renders to one
row for each block, in order.

Rows without a conversation id belong to none and are left out. A null turn
sorts first, ties sort by role and text, a repeated row counts once; a null role
is ``user`` and a null text is empty. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

BLOCK = 256


def turns(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, position, role, text, h1, h2): distinct turns, numbered from 0, with the hashes of the prefix that each ends."""
    rows = conversations.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62))).cast("long").alias("block"),
    ).distinct()
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    rows = rows.withColumn("place", F.row_number().over(inside) - 1)
    # positions before hashes: a block's first position is the size of those before it
    sizes = rows.groupBy("conv_id", "block").agg(F.count("*").alias("size"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("conv_id", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"))
    rows = rows.join(first, ["conv_id", "block"]).withColumn("position", F.col("first") + F.col("place"))
    rows = rows.withColumns({f"t{k}": F.xxhash64(F.lit(k), "position", "role", "text") for k in (1, 2)})
    rows = materialise(rows.select("conv_id", "block", "position", "role", "text", "t1", "t2"))
    whole = rows.groupBy("conv_id", "block").agg(*[F.bit_xor(f"t{k}").alias(f"b{k}") for k in (1, 2)])
    whole = whole.select("conv_id", "block", *[F.coalesce(F.bit_xor(f"b{k}").over(before), F.lit(0)).alias(f"b{k}") for k in (1, 2)])
    running = Window.partitionBy("conv_id", "block").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(whole, ["conv_id", "block"])
    return rows.select("conv_id", "position", "role", "text", *[F.bit_xor(f"t{k}").over(running).bitwiseXOR(F.col(f"b{k}")).alias(f"h{k}") for k in (1, 2)])


def maximal(rolled: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of conversations that are no prefix of another; of equal ones, the least id."""
    last = rolled.groupBy("conv_id").agg(F.max(F.struct("position", "h1", "h2")).alias("last"))
    ends = last.select("conv_id", "last.*").groupBy("position", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    longest = last.select("conv_id", F.col("last.position").alias("end"))
    inner = rolled.select("conv_id", "position", "h1", "h2").join(longest, "conv_id").where("position < end")
    longer = inner.select("position", "h1", "h2").distinct()
    kept = ends.join(longer, ["position", "h1", "h2"], "left_anti")
    return kept.select("conv_id", (F.col("position") + 1).alias("n_turns"))


def format_chats(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, n_turns, part, chat): maximal conversations as text."""
    rolled = materialise(turns(conversations, block))
    kept = materialise(maximal(rolled))
    rows = rolled.join(kept, "conv_id").withColumn("part", F.floor(F.col("position") / block))
    line = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n"))
    parts = rows.groupBy("conv_id", "n_turns", "part").agg(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("lines"))
    return parts.select("conv_id", "n_turns", "part", F.array_join("lines.line", "").alias("chat"))


#: ``format_chats`` over ``conversations`` for DuckDB, by whole prefixes.
SQL = r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, COALESCE(role, 'user') AS role, COALESCE(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (
  SELECT conv_id, ROW_NUMBER() OVER w - 1 AS position, COUNT(*) OVER (PARTITION BY conv_id) AS n_turns,
         '<|' || role || '|>' || CHR(10) || text || CHR(10) AS line,
         STRING_AGG(role || CHR(1) || text || CHR(2), '') OVER w AS prefix
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ends AS (SELECT prefix, MIN(conv_id) AS conv_id FROM n WHERE position + 1 = n_turns GROUP BY prefix),
kept AS (SELECT conv_id FROM ends e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.prefix = e.prefix AND n.position + 1 < n.n_turns))
SELECT conv_id, n_turns, (position // 256)::BIGINT AS part, STRING_AGG(line, '' ORDER BY position) AS chat
FROM n JOIN kept USING (conv_id) GROUP BY conv_id, n_turns, position // 256
"""
