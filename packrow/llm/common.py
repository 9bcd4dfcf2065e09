"""What the operators of this subpackage share: inputs, the shared scratch folder, words, folds."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch that are turned into Python objects at a time.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the session names none, local mode gets one under /tmp; a cluster must name it.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "/tmp/checkpoints"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).deleteOnExit(where)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def swept(spark: SparkSession) -> None:
    """Let go of the shuffle files of jobs that are over: Spark removes them when the driver's garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage is cut, and lost executors cost nothing."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt_keys(n: int) -> np.ndarray:
    """For each of ``n`` partitions an int that Spark's hash partitioning puts there."""
    keys, found = np.arange(32 * n + 64, dtype=np.uint32), np.full(n, -1, np.int64)
    with np.errstate(over="ignore"):
        while (found < 0).any():
            h = keys * np.uint32(0xCC9E2D51)
            h = (h << np.uint32(15) | h >> np.uint32(17)) * np.uint32(0x1B873593) ^ np.uint32(42)
            h = (h << np.uint32(13) | h >> np.uint32(19)) * np.uint32(5) + np.uint32(0xE6546B64) ^ np.uint32(4)
            h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
            h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
            at = (h ^ h >> np.uint32(16)).view(np.int32) % np.int32(n)
            new = found[at] < 0
            found[at[new][::-1]] = keys[new][::-1]
            keys += np.uint32(len(keys))
    return found.astype(np.int32)


class Blocks:
    """Ranges of doc_id with about the same number of text bytes, each named by a key that has a partition of its own.

    ``docs`` has doc_id (null counts as 0) and text. The number of blocks follows the bytes; the limits, one number each,
    pass through the driver. Rows of one doc_id stay together.
    """

    _UNIT = 4096

    def __init__(self, docs: DataFrame, size: int, n: int | None = None):
        length = F.coalesce(F.octet_length("text"), F.lit(0))
        doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
        n = n or max(1, -(-int(docs.agg(F.sum(length.cast("long"))).first()[0] or 0) // size))
        found = []
        if n > 1:
            weighed = docs.select(doc.alias("d"), F.explode(F.sequence(F.lit(0), (length / self._UNIT).cast("int"))))
            found = weighed.agg(F.percentile_approx("d", [i / n for i in range(1, n)], max(10_000, 20 * n))).first()[0]
        self.edges = np.array(sorted(set(found or [])), np.int64)
        self.n = len(self.edges) + 1
        self.keys = dealt_keys(self.n)

    def of(self, ids: pa.Array) -> np.ndarray:
        """The key of each id's block."""
        return self.keys[np.searchsorted(self.edges, ids.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False), side="right")]


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; an id of null counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", rows: int = SLICE_ROWS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with the text column as Python strings; null becomes the empty text."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            yield part, [x or "" for x in part.column(part.schema.get_field_index(column)).to_pylist()]
