"""Mix sources to target weights by nested hash thresholds.

Every document gets a 60-bit hash of its id. A source whose target is ``m``
whole passes and a rest takes each document ``m`` times, and once more if its
hash lies below the source's threshold. The threshold comes from histograms:
words by source and hash bucket give the bucket in which the running sum meets
the budget, only that bucket is refined, twice, and rows are then filtered by
hash. No rows are sorted; reruns choose the same documents.

Targets: source weights 5, 2, 1, repeating by code point (null last), share all
words; a target stops at ``MOST`` times its source, and the excess is reshared
by weight until none is above. The document at the threshold is in when that
brings the sum nearer to the budget. Rows with the same id and source share a
hash and fall on one side together. A null text has size 0; a null id hashes as
an empty text. Other columns pass through ``mix`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, n_words

WEIGHTS = (5, 2, 1)
MOST = 3
#: Sources up to which a table with a row for each is sent to all tasks; beyond, the join is salted.
SENT = 20_000
SALTS = 32
_LEVELS = (48, 36)  # bits below the histogram's buckets, coarse then fine


def with_source(rows: DataFrame, per: DataFrame, salt: Column) -> DataFrame:
    """``rows`` (source, ...) joined with ``per`` (s, ...), one row a source, without bringing a hot source together."""
    same = F.col("source").eqNullSafe(F.col("s"))
    if per.count() <= SENT:
        return rows.join(F.broadcast(per), same).drop("s")
    spread = per.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("__deal", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    return dealt.join(spread, same & (F.col("__deal") == F.col("__salt"))).drop("s", "__deal", "__salt")


def doc_hash(id_col: Column) -> Column:
    """60 bits of the id's MD5 as a long."""
    text = F.coalesce(id_col.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from rows (source, size)."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("long"))
    # Sources reach their limit in the order of size to weight; with k of them at it, the rest share what is left.
    order = Window.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("left", F.sum("source_size").over(whole) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("share", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("open", F.col("w") * F.col("left") <= most * F.col("source_size") * F.col("share"))
    )
    first = F.min_by(F.struct("left", "share"), F.when(F.col("open"), F.col("source_size") / F.col("w"))).over(whole)
    per = per.withColumn("rest", first)
    fair = (F.col("w") * F.col("rest.left")).cast("double") / F.col("rest.share")
    limit = (most * F.col("source_size")).cast("double")
    return per.select("source", "source_size", F.coalesce(F.least(fair, limit), F.lit(0.0)).alias("target"))


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, passes, below): rows take ``passes`` copies, and one more where h < below."""
    plan = goals.select(
        "source",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int").alias("passes"),
        "target", "source_size",
    ).select("source", "passes", (F.col("target") - F.col("passes") * F.col("source_size")).alias("budget"))
    rows = sized
    state = plan.select("source", "budget", F.lit(0.0).alias("taken"))
    for bits in _LEVELS:
        sums = rows.groupBy("source", F.shiftright("h", bits).alias("bucket")).agg(F.sum("size").alias("words"))
        running = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("after", F.sum("words").over(running))
        s = state.select(F.col("source").alias("s"), "budget", "taken")
        met = sums.join(s, F.col("source").eqNullSafe(F.col("s"))).where(F.col("taken") + F.col("after") > F.col("budget"))
        state = met.groupBy("source", "budget").agg(
            F.min("bucket").alias("bucket"),
            F.min_by(F.col("taken") + F.col("after") - F.col("words"), "bucket").alias("taken"),
        )
        state = materialise(state)
        edge = state.select(F.col("source").alias("s"), F.col("bucket").alias("at"))
        rows = with_source(rows, edge, F.col("h")).where(F.shiftright("h", bits) == F.col("at")).select("source", "h", "size")
    exact = rows.groupBy("source", "h").agg(F.sum("size").alias("words"))
    exact = exact.withColumn("after", F.sum("words").over(Window.partitionBy("source").orderBy("h")))
    s = state.select(F.col("source").alias("s"), "budget", "taken")
    over = exact.join(s, F.col("source").eqNullSafe(F.col("s"))).withColumn("sum", F.col("taken") + F.col("after"))
    over = over.where(F.col("sum") > F.col("budget"))
    edge = over.groupBy("source").agg(
        F.min("h").alias("h"), F.min_by(F.col("sum") - F.col("budget") < F.col("budget") - (F.col("sum") - F.col("words")), "h").alias("in")
    ).select(F.col("source").alias("s"), (F.col("h") + F.col("in").cast("long")).alias("below"))
    # A budget of a whole pass, to rounding, meets no edge: everything is below.
    out = plan.join(edge, plan["source"].eqNullSafe(edge["s"]), "left")
    return out.select("source", "passes", F.coalesce("below", F.when(F.col("budget") > 0, F.lit(1 << 60)).otherwise(0)).alias("below"))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of each row."""
    sized = materialise(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), doc_hash(F.col(id_col)).alias("h"))
    )
    goals = materialise(targets(sized))
    cut = thresholds(sized.select("source", "h", "size"), goals).withColumnRenamed("source", "s")
    goal = materialise(goals.join(cut, F.col("source").eqNullSafe(F.col("s"))).drop("source"))
    copies = F.col("passes") + (F.col("h") < F.col("below")).cast("int")
    return (
        with_source(sized, goal, F.col("h"))
        .withColumn("copies", copies)
        .select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed rows: each row of ``docs`` as often as the mix takes it."""
    sized = materialise(docs.select(F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), doc_hash(F.col(id_col)).alias("h")))
    cut = materialise(thresholds(sized, materialise(targets(sized))).toDF("s", "passes", "below"))
    rows = docs.select(F.col(source_col).alias("source"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    own = F.col("doc").getField(id_col)
    copies = F.col("passes") + (doc_hash(own) < F.col("below")).cast("int")
    return with_source(rows, cut, own).withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies))).select("doc.*")


#: ``plan_mix`` over ``documents`` for DuckDB.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, COALESCE(LEN(REGEXP_EXTRACT_ALL(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || SUBSTR(MD5(COALESCE(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
per AS (
  SELECT source, SUM(size)::BIGINT AS source_size,
         [5, 2, 1][1 + ((ROW_NUMBER() OVER (ORDER BY source NULLS LAST)) - 1) % 3]::BIGINT AS w
  FROM sized GROUP BY source),
steps AS (
  SELECT *, SUM(source_size) OVER () - 3 * COALESCE(SUM(source_size) OVER b, 0) AS remaining,
         SUM(w) OVER () - COALESCE(SUM(w) OVER b, 0) AS share
  FROM per WINDOW b AS (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rest AS (
  SELECT remaining AS l, share AS s FROM steps WHERE w * remaining <= 3 * source_size * share
  ORDER BY source_size::DOUBLE / w LIMIT 1),
goals AS (
  SELECT source, source_size, COALESCE(LEAST((w * l)::DOUBLE / s, (3 * source_size)::DOUBLE), 0.0) AS target
  FROM per LEFT JOIN rest ON TRUE),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN FLOOR(target / source_size)::BIGINT ELSE 0 END AS passes FROM goals),
groups AS (
  SELECT source, h, SUM(size) AS words FROM sized GROUP BY source, h),
sums AS (
  SELECT g.source, g.h, g.words, SUM(g.words) OVER (PARTITION BY g.source ORDER BY g.h) AS after,
         p.target - p.passes * p.source_size AS budget
  FROM groups g JOIN plan p ON g.source IS NOT DISTINCT FROM p.source),
chosen AS (
  SELECT source, h, budget > 0 AND (after <= budget OR (after - words <= budget AND after - budget < budget - (after - words))) AS extra
  FROM sums)
SELECT d.doc_id, d.size, p.source_size, p.target, ((p.passes + c.extra::BIGINT) * d.size)::BIGINT AS taken
FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
JOIN chosen c ON c.source IS NOT DISTINCT FROM d.source AND c.h = d.h
"""
