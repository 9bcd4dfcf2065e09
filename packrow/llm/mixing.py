"""Mixing sources to target weights by weighted fair queueing.

Within its source every document stands in a shuffled order (by the md5 of its id), once for each
copy that may be taken. Its virtual finish time is the words its source has queued up to and
including it, divided by the source's target. The mix is the documents in order of that time
until the total budget is used.

No source and no time range is sorted in one task: prefix sums add totals of sub-buckets (the
first digits of the md5) and of time bins, and only the bin in which the budget runs out is
sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packrow.llm import common

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, RATIO, MOST = (5, 2, 1), 1.5, 2
#: Time bins for one unit of virtual time, and the last bin, which takes what finishes later.
BINS, LAST_BIN = 1 << 16, 1 << 24


def size_of(text: Column) -> Column:
    """Words in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, ratio: float = RATIO, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row for each source.

    Sources by code point, null last, get the weights in turn. Targets share ``ratio`` times all
    sizes by weight; one that would be above ``most`` times its source's size stops there and the
    rest is shared again. The windows here run over one row for each source.
    """
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1)
    all_words = F.coalesce(F.sum("source_size").over(W.partitionBy()), F.lit(0))
    d = sources.withColumn("weight", weigh).withColumn("budget", all_words * F.lit(float(ratio))).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_level = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    d = d.withColumn("spent", F.coalesce(F.sum("cap").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    d = d.withColumn("left", F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing)))
    d = d.withColumn("level", (F.col("budget") - F.col("spent")) / F.col("left")).withColumn("full", F.col("level") >= F.col("cap") / F.col("weight"))
    rest = F.min_by(F.when(~F.col("full"), F.col("level")), F.when(~F.col("full"), F.col("cap") / F.col("weight"))).over(W.partitionBy())
    return d.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(rest * F.col("weight")).alias("target"))


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, ratio: float = RATIO, most: int = MOST) -> DataFrame:
    """(source, doc_id, size, n, source_size, target, copies) for each different (source, doc_id, size).

    ``n`` rows share such a triple and fare alike; ``copies`` is how often each of them is taken, 0
    to ``most``. Null ids shuffle as the empty text, null sources are one source. The order and so
    the result depend only on the rows, not on their layout.
    """
    spark = sized.sparkSession
    rows = sized.groupBy("source", "doc_id", "size").agg(F.count("*").alias("n"))
    rows = rows.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))).withColumn("sub", F.substring("h", 1, 3))
    rows = common.written(spark, rows, "mix-rows")
    subs = rows.groupBy("source", "sub").agg(F.sum(F.col("n") * F.col("size")).alias("words"))
    subs = subs.withColumn("before", F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("sub").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    goals = targets(subs.groupBy("source").agg(F.sum("words").alias("source_size")), weights, ratio, most)
    subs = subs.alias("s").join(goals.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select("s.source", "sub", "before", "source_size", "target")
    same = F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.sub") == F.col("s.sub"))
    queued = rows.alias("r").join(subs.alias("s"), same).select("r.*", "before", "source_size", "target")
    within = W.partitionBy("source", "sub").orderBy("h", F.col("doc_id").asc_nulls_first(), "size")
    queued = queued.withColumn("queued", F.col("before") + F.sum(F.col("n") * F.col("size")).over(within))
    queued = common.written(spark, queued.drop("before", "sub"), "mix-queued")

    finish = (F.col("queued") + F.col("copy") * F.col("source_size")).cast("double") / F.col("target")
    finish = F.when(F.col("target") > 0, finish).otherwise(F.lit(0.0))
    copies = queued.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("finish", finish)
    copies = copies.withColumn("bin", F.least(F.floor(F.col("finish") * BINS), F.lit(LAST_BIN)).cast("long"))
    budget = F.sum("source_size").over(W.partitionBy()) * F.lit(float(ratio))
    total = goals.select(budget.alias("b")).first()
    total = total[0] if total is not None and total[0] is not None else 0.0
    bins = copies.groupBy("bin").agg(F.sum(F.col("n") * F.col("size")).alias("words"))
    # Coarse bins first, so that the prefix sum over all bins is never one task's work.
    coarse = bins.groupBy(F.shiftright("bin", 8).alias("top")).agg(F.sum("words").alias("words"))
    coarse = coarse.withColumn("upto", F.sum("words").over(W.orderBy("top"))).where(F.col("upto") > total).orderBy("top").select("top", F.col("upto") - F.col("words")).first()
    if coarse is None:
        return queued.withColumn("copies", F.lit(most)).drop("queued", "h")
    fine = bins.where(F.shiftright("bin", 8) == coarse[0]).withColumn("upto", F.lit(coarse[1]) + F.sum("words").over(W.orderBy("bin")))
    at, before = fine.where(F.col("upto") > total).orderBy("bin").select("bin", F.col("upto") - F.col("words")).first()
    #: Null sources stand last in the order of the mix, null ids first.
    rank = F.struct("finish", F.col("source").isNull().alias("last"), F.coalesce("source", F.lit("")).alias("source"), "h", F.col("doc_id").isNotNull().alias("some"), F.coalesce("doc_id", F.lit(0)).alias("id"), "size", "copy")
    edge = copies.where(F.col("bin") == at).withColumn("rank", rank)
    edge = edge.withColumn("upto", F.lit(before) + F.sum(F.col("n") * F.col("size")).over(W.orderBy("rank")))
    last = edge.where(F.col("upto") <= total).agg(F.max("rank").alias("rank")).first()[0]
    judged = copies.withColumn("rank", rank)
    within_edge = F.lit(False) if last is None else F.col("rank") <= F.struct(*[F.lit(v).cast(t.dataType).alias(t.name) for v, t in zip(last, judged.schema["rank"].dataType, strict=True)])
    taken = (F.col("bin") < at) | ((F.col("bin") == at) & within_edge)
    return judged.groupBy("source", "doc_id", "size", "n", "source_size", "target").agg(F.sum(taken.cast("int")).alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, ratio: float = RATIO, most: int = MOST) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken) for every row of ``docs``.

    taken counts a document's words once for each copy the mix takes. Texts of null or without
    words have size 0 and take nothing; a source of such texts has target 0. Rows that are alike
    in id, source and size are taken alike. An empty table gives an empty table. Columns beside
    doc_id, text and source aren't read.
    """
    sized = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"))
    planned = plan(sized, weights, ratio, most)
    rows = planned.withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return rows.select("doc_id", "size", "source", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, ratio: float = RATIO, most: int = MOST) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it is taken, with their own columns."""
    size, copy = common.fresh(docs, "_size", "_copy")
    sized = docs.withColumn(size, size_of(F.col("text")))
    planned = plan(sized.select("doc_id", "source", F.col(size).alias("size")), weights, ratio, most).where("copies > 0")
    same = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col(f"d.{size}") == F.col("p.size"))
    rows = sized.alias("d").join(planned.alias("p"), same).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select("d.*").drop(size)


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
    CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS budget, CAST(source_size AS DOUBLE) * 2.0::DOUBLE AS cap FROM sources),
levels AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS spent,
    sum(weight) OVER (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS remaining FROM weighed),
leveled AS (SELECT *, (budget - spent) / remaining AS level FROM levels),
goals AS (
  SELECT source, source_size, budget, CASE WHEN level >= cap / weight THEN cap
    ELSE weight * (SELECT min_by(level, cap / weight) FROM leveled WHERE level < cap / weight) END AS target FROM leveled),
queued AS (
  SELECT s.doc_id, s.size, s.source, g.source_size, g.target, g.budget, md5(coalesce(CAST(s.doc_id AS VARCHAR), '')) AS h,
    CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(CAST(s.doc_id AS VARCHAR), '')), s.doc_id, s.size) AS BIGINT) AS queued
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
copies AS (
  SELECT *, CASE WHEN target > 0 THEN CAST(queued + copy * source_size AS DOUBLE) / target ELSE 0.0 END AS finish
  FROM queued, (SELECT unnest([0, 1]) AS copy)),
cut AS (
  SELECT *, sum(size) OVER (ORDER BY finish, encode(source) NULLS LAST, h, doc_id NULLS FIRST, size, copy) AS upto FROM copies)
SELECT doc_id, size, source, source_size, target, CAST(sum(CASE WHEN upto <= budget THEN size ELSE 0 END) AS BIGINT) AS taken
FROM cut GROUP BY doc_id, size, source, source_size, target, h, queued
"""
