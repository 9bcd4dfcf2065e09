"""Connected components by alternating large-star and small-star rounds, all in DataFrames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packrow.llm import common


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node next to it."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("m").alias("a"), "b")
    own = least.select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(own).where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node on an edge; component is the smallest node it reaches.

    ``edges`` has two columns of one orderable type; loops and nulls are ignored. Each round
    is two pre-aggregated minima and joins, so a hub costs no more than its edges, and ends in a
    reliable checkpoint. An empty table gives an empty table. ``rounds`` bounds a run that
    doesn't settle, which raises instead of returning something partial.
    """
    spark = edges.sparkSession
    common.shared_dir(spark)
    a, b = edges.columns
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    now = now.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().checkpoint()
    mark = None
    for _ in range(rounds):
        now = _small_star(_large_star(now)).checkpoint()
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        mark = tuple(seen)
        common.swept(spark)
    raise RuntimeError("components did not settle")


def few_components(edges: DataFrame) -> DataFrame:
    """What :func:`components` gives, for edges between longs that are few enough for the driver."""
    rows = edges.toDF("a", "b").where("a <> b").toArrow()
    a, b = (np.asarray(rows.column(i).to_numpy(), np.int64) for i in (0, 1))
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    head, before = np.arange(len(names)), None
    while before is None or (head != before).any():
        before = head.copy()
        least = np.minimum(head[x], head[y])
        for ends in (head[x], head[y], x, y):
            np.minimum.at(head, ends, least)
        head = head[head]
    return edges.sparkSession.createDataFrame(pa.table({"node": names, "component": names[head]}), "node long, component long")
