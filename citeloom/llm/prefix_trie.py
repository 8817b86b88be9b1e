"""Trie of conversation prefixes by van Emde Boas recursion.

A sequence of up to 2^k turns is cut after 2^(k-1) of them. The part before the
cut is named by a hash of 128 bits, so that equal parts become one, with the
number and the least id of the conversations that have it; they make the upper
trie, and what follows them makes a forest below, a tree for each name. All
trees of one height are cut at once, upper and lower alike, down to single turns,
which are the nodes. Names are exclusive ors of the turns' hashes, each taken
with its position, so a prefix has one name however it was cut.

Totals climb the same cuts. A tree's total is that of its upper trie and of the
forest below; what a lower tree adds to the node that it hangs from, and to all
above that in the upper trie, is handed to the two halves of the upper trie, and
so on down to single nodes. Every step reads and writes at most one row a node
of the depths at its cuts.

Rows without a conversation are left out; a null role or text is empty. Turns
are in order of ``turn``, null first, ties by role, the first ``HEAD`` characters
of the text, then its hash; repeated rows are as many turns. A position comes
from a sort over all rows, so a conversation of any length and any number of
equal rows is dealt over tasks. An empty table has no node. Other columns are
not read. A list of ids is hashed in pieces of ``CHUNK`` characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: A conversation takes its first ``crc32(id) % LEAD`` turns from the first of its ``FAMILY``.
FAMILY, LEAD = 100, 6
HEAD = 64
CHUNK = 2048
ROOT = (0, 0)


def positions(conversations: DataFrame) -> DataFrame:
    """(conv_id, position, d1, d2, chars, own): turns in order, with the number of turns of their conversation."""
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = rows.select(
        "conv_id", "turn", "role", F.substring("text", 1, HEAD).alias("head"), F.char_length("text").cast("long").alias("chars"),
        *[F.xxhash64(F.lit(k), "role", "text").alias(f"d{k}") for k in (1, 2)], F.rand(13).alias("deal"),
    )
    order = ["conv_id", "turn", "role", "head", "d1", "d2", "deal"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialise(rows.select("conv_id", "d1", "d2", "chars", F.monotonically_increasing_id().alias("at")))
    rows = rows.withColumn("part", F.shiftright("at", 33))
    runs = rows.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy("conv_id")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv_id", "part", (F.col("first") - F.coalesce(F.sum("n").over(before), F.lit(0))).alias("first"), F.sum("n").over(whole).alias("own"))
    return rows.join(runs, ["conv_id", "part"]).select("conv_id", (F.col("at") - F.col("first")).alias("position"), "d1", "d2", "chars", "own")


def rebuild(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, position, turns, b1, b2, chars) after the lead of each conversation was taken from its family's first, and (conv_id, turns)."""
    lead = F.crc32(F.col("conv_id").cast("string").cast("binary")) % LEAD
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    numbered = materialise(numbered)
    sizes = numbered.where("position = 0").select("conv_id", "own", lead.alias("lead"), family.alias("family"))
    firsts = numbered.where((F.col("conv_id") == family) & (F.col("position") < LEAD))
    heads = firsts.where("position = 0").select(F.col("conv_id").alias("family"), F.least("own", F.lit(LEAD)).alias("has"))
    sizes = sizes.join(heads, "family", "left").withColumn("taken", F.least("lead", F.coalesce("has", F.lit(0))))
    sizes = materialise(sizes.withColumn("turns", F.col("taken") + F.greatest(F.col("own") - F.col("lead"), F.lit(0))).select("conv_id", "family", "lead", "taken", "turns"))
    own = numbered.join(sizes.select("conv_id", "lead", "taken", "turns"), "conv_id").where("position >= lead")
    own = own.select("conv_id", (F.col("position") - F.col("lead") + F.col("taken")).alias("position"), "turns", "d1", "d2", "chars")
    taken = firsts.withColumnRenamed("conv_id", "family").join(sizes.where("taken > 0"), "family").where("position < lead")
    turns = own.unionByName(taken.select("conv_id", "position", "turns", "d1", "d2", "chars"))
    named = [F.xxhash64(F.lit(k), "position", "d1", "d2").alias(f"b{k}") for k in (1, 2)]
    return turns.select("conv_id", "position", "turns", *named, "chars"), sizes.select("conv_id", "turns")


def _xor(a: str, b: str) -> list[Column]:
    return [F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}")) for k in (1, 2)]


def _tall(size: Column, k: int) -> Column:
    """Whether a sequence of so many turns needs a tree of height 2^k."""
    return (size > (1 << k - 1 if k else 0)) & (size <= 1 << k)


def cut(turns: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """By k, the distinct (root, block) of trees of height 2^k; and the whole block of each conversation.

    A tree's row holds the root's name r, its depth, the block's name b and size, and the number and least id of
    the conversations that have it.
    """
    blocks = [turns.select("conv_id", F.col("position").alias("j"), "turns", "b1", "b2", F.lit(1).cast("long").alias("size"))]
    longest = turns.agg(F.max("turns")).first()[0] or 0
    height = max(0, longest - 1).bit_length()
    for k in range(1, height + 1):
        half = blocks[-1].where(F.col("turns") > 1 << k - 1)
        left = [F.max(F.when(F.col("j") % 2 == 0, F.col(f"b{i}"))).alias(f"l{i}") for i in (1, 2)]
        sums = [*[F.bit_xor(f"b{i}").alias(f"b{i}") for i in (1, 2)], F.sum("size").alias("size"), F.max("turns").alias("turns")]
        blocks.append(materialise(half.groupBy("conv_id", F.shiftright("j", 1).alias("j")).agg(*sums, *left)))
    tops = [b.where((F.col("j") == 0) & _tall(F.col("turns"), k)).select("conv_id", "b1", "b2", "size") for k, b in enumerate(blocks)]
    trees: list[DataFrame] = []
    parts: list[DataFrame] = []
    for k in range(height, -1, -1):
        none = [F.lit(0).cast("long").alias(c) for c in ("r1", "r2", "depth")]
        rows = tops[k].select(*none, "b1", "b2", "size", F.lit(1).cast("long").alias("n"), F.col("conv_id").alias("least"))
        rows = reduce(DataFrame.unionByName, [p.where(_tall(F.col("size"), k)) for p in parts], rows)
        tree = rows.groupBy("r1", "r2", "b1", "b2").agg(F.max("depth").alias("depth"), F.max("size").alias("size"), F.sum("n").alias("n"), F.min("least").alias("least"))
        trees.append(materialise(tree))
        if k:
            half = 1 << k - 1
            halves = blocks[k].where(F.col("size") > half).groupBy("b1", "b2").agg(F.first("l1").alias("l1"), F.first("l2").alias("l2"))
            both = trees[-1].join(halves, ["b1", "b2"])
            upper = F.struct("r1", "r2", "depth", F.col("l1").alias("b1"), F.col("l2").alias("b2"), F.lit(half).cast("long").alias("size"))
            below, rest = _xor("r", "l"), _xor("b", "l")
            lower = F.struct(
                below[0].alias("r1"), below[1].alias("r2"), (F.col("depth") + half).alias("depth"),
                rest[0].alias("b1"), rest[1].alias("b2"), (F.col("size") - half).alias("size"),
            )
            parts.append(materialise(both.select(F.explode(F.array(upper, lower)).alias("part"), "n", "least").select("part.*", "n", "least")))
    return trees[::-1], reduce(DataFrame.unionByName, [t.select("conv_id", "b1", "b2") for t in tops])


def _added(rows: DataFrame) -> DataFrame:
    return rows.groupBy("e1", "e2").agg(F.max("depth").alias("depth"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def graft(nodes: DataFrame, trees: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """What all nodes below add to each node, as (e1, e2, depth, leaves, saved), and the same for the root alone."""
    ends = [t.where(F.col("size") == 1 << k).select("r1", "r2", *[c.alias(f"e{i + 1}") for i, c in enumerate(_xor("r", "b"))]) for k, t in enumerate(trees)]

    def climb(rows: DataFrame, k: int) -> DataFrame:
        """Rows at the bottom of trees of height 2^k, at the roots of these."""
        up = rows.join(ends[k], ["e1", "e2"])
        return up.select(F.col("r1").alias("e1"), F.col("r2").alias("e2"), (F.col("depth") - (1 << k)).alias("depth"), "leaves", "saved")

    total = _added(nodes.select(F.col("p1").alias("e1"), F.col("p2").alias("e2"), (F.col("depth") - 1).alias("depth"), "leaves", "saved"))
    total, hung = materialise(total), []
    for k in range(len(trees) - 1):
        odd = F.shiftright("depth", k) % 2 == 1
        hung.append(total.where(odd))
        total = materialise(_added(total.where(~odd).unionByName(climb(hung[-1], k))))
    given = None
    for k in range(len(trees) - 2, -1, -1):
        rows = hung[k] if given is None else hung[k].unionByName(given).unionByName(climb(given, k))
        given = materialise(_added(rows))
    return (given if given is not None else total.limit(0)), total.where(F.col("depth") == 0)


def hashed_ids(members: DataFrame) -> DataFrame:
    """(e1, e2, sha256) of each node's ``conv_id``s, ascending and comma-joined."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, size, first = None, [], 0, None
        out: list[tuple] = []
        for batch in batches:
            for e1, e2, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (e1, e2) != node or size > CHUNK:
                    if ids:
                        out.append((*node, first, ",".join(ids)))
                    node, ids, size, first = (e1, e2), [], 0, c
                ids.append(str(c))
                size += len(ids[-1]) + 1
            yield batched(out)
            out = []
        if ids:
            yield batched([(*node, first, ",".join(ids))])

    def batched(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds)], names=["e1", "e2", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        out: list[tuple] = []
        for batch in batches:
            for e1, e2, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if (e1, e2) != node:
                    if node:
                        out.append((*node, sha.hexdigest()))
                    node, sha = (e1, e2), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield hashes(out)
            out = []
        if node:
            yield hashes([(*node, sha.hexdigest())])

    def hashes(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 3, kinds)], names=["e1", "e2", "sha256"])

    order = ["e1", "e2", "conv_id"]
    pieces = members.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, "e1 long, e2 long, first long, ids string")
    return pieces.repartition("e1", "e2").sortWithinPartitions("e1", "e2", "first").mapInArrow(digest, "e1 long, e2 long, sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row for each prefix."""
    turns, sizes = rebuild(positions(conversations))
    turns = materialise(turns)
    trees, wholes = cut(turns)
    chars = turns.groupBy("b1", "b2").agg(F.max("chars").alias("chars"))
    edges = trees[0].join(chars, ["b1", "b2"]).withColumn("depth", F.col("depth") + 1)
    ends = [c.alias(f"e{k + 1}") for k, c in enumerate(_xor("r", "b"))]
    saved = ((F.col("n") - 1) * F.col("chars")).alias("saved")
    edges = edges.select(*ends, F.col("r1").alias("p1"), F.col("r2").alias("p2"), "depth", "n", "least", saved)
    children = edges.groupBy("p1", "p2").agg(F.count("*").alias("children")).toDF("e1", "e2", "children")
    nodes = edges.join(children, ["e1", "e2"], "left").fillna(0, ["children"]).withColumn("leaves", (F.col("children") == 0).cast("long"))
    nodes = materialise(nodes)
    below, top = graft(nodes, trees)
    none = [F.lit(x).cast("long").alias(f"b{k + 1}") for k, x in enumerate(ROOT)]
    members = wholes.unionByName(sizes.where("turns = 0").select("conv_id", *none)).toDF("conv_id", "e1", "e2")
    hashes = materialise(hashed_ids(members))
    # the root has no turn: its row comes from counts of conversations and of its children
    n, least = sizes.agg(F.count("*"), F.min("conv_id")).first()
    leaves, saved = top.agg(F.coalesce(F.sum("leaves"), F.lit(1)), F.coalesce(F.sum("saved"), F.lit(0))).first()
    rows = [(*ROOT, 0, n, least, saved, nodes.where("depth = 1").count(), leaves, None)] if n else []
    schema = "e1 long, e2 long, depth long, n long, least long, saved long, children long, leaves long, parent long"
    root = nodes.sparkSession.createDataFrame(rows, schema)
    more = below.select("e1", "e2", F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))
    inner = nodes.join(more, ["e1", "e2"], "left").fillna(0, ["more_leaves", "more_saved"])
    inner = inner.withColumns({"leaves": F.col("leaves") + F.col("more_leaves"), "saved": F.col("saved") + F.col("more_saved")})
    names = nodes.select(F.col("e1").alias("p1"), F.col("e2").alias("p2"), F.col("least").alias("parent"))
    names = names.unionByName(root.select(F.col("e1").alias("p1"), F.col("e2").alias("p2"), F.col("least").alias("parent")))
    inner = inner.join(names, ["p1", "p2"]).select(*root.columns)
    out = inner.unionByName(root).join(hashes, ["e1", "e2"], "left")
    return out.select(
        F.col("least").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


#: ``trie`` over ``conversations`` for DuckDB, by whole prefixes. A digit of an id is one byte of the checksum.
SQL = r"""
WITH RECURSIVE o AS (
  SELECT conv_id, COALESCE(role, '') AS role, COALESCE(text, '') AS text,
         ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, COALESCE(role, ''), COALESCE(text, '')) - 1 AS position
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS family, (xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(1, LENGTH(conv_id::VARCHAR) + 1), lambda i: ASCII(SUBSTR(conv_id::VARCHAR, i, 1))::BIGINT)),
      lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))) % 6 AS lead
  FROM (SELECT DISTINCT conv_id FROM o)),
r AS (
  SELECT c.conv_id, 0 AS part, o.position, o.role, o.text FROM c JOIN o ON o.conv_id = c.family AND o.position < c.lead
  UNION ALL
  SELECT c.conv_id, 1, o.position, o.role, o.text FROM c JOIN o ON o.conv_id = c.conv_id AND o.position >= c.lead),
p AS (
  SELECT conv_id, ROW_NUMBER() OVER w AS depth, LENGTH(text) AS chars, SHA256(STRING_AGG(SHA256(role) || SHA256(text), '') OVER w) AS name
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM c),
m AS (
  SELECT *, LAG(name) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, MAX(depth) OVER (PARTITION BY conv_id) = depth AS ends FROM p),
n AS (
  SELECT name, MAX(depth) AS depth, MIN(parent) AS parent, MIN(conv_id) AS conv_id, COUNT(*) AS n_convs, (COUNT(*) - 1) * MAX(chars) AS saved,
         SHA256(COALESCE(STRING_AGG(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM m GROUP BY name),
k AS (SELECT parent AS name, COUNT(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
v AS (SELECT n.*, COALESCE(n_children, 0) AS n_children FROM n LEFT JOIN k USING (name)),
up AS (
  SELECT name, parent, (n_children = 0)::INT AS leaves, saved FROM v
  UNION ALL
  SELECT v.name, v.parent, up.leaves, up.saved FROM up JOIN v ON v.name = up.parent),
t AS (SELECT name, SUM(leaves)::BIGINT AS n_leaves, SUM(saved)::BIGINT AS saved_tokens FROM up GROUP BY name)
SELECT v.conv_id, v.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, v.n_convs, v.n_children, t.n_leaves, t.saved_tokens, v.ends_sha256
FROM v JOIN t USING (name) LEFT JOIN n q ON q.name = v.parent
"""
