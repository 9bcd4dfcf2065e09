"""Line dedup over levelled sorted runs of line hashes; DataFrame functions only.

A run holds one row for each line key: its 128-bit hash, in how many documents of the run's batches
the key stands, and the largest doc_id of them. Batches come in descending order of doc_id. The lines of
each new batch are merge-joined with the runs: keys the runs miss are the anti-join's new keys and
name the document that keeps the line, keys they hold add their counts. The batch's own run joins
level 0. When a level has ``FANOUT`` runs they
are compacted into one run of the next level. Runs are immutable Parquet tables, hash-partitioned
and sorted by key in the shared folder, so a lost executor costs one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packrow.llm import common

MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 40, 5, 4, 3
#: Keys with more than this share of all lines are joined by broadcast, so there are at most as many of them as its inverse.
HEAVY = 1 / 4096
_BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def key_of(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(_BLANKS)), _UPPER, _LOWER)


def _hash(key: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a key, 128 bits together."""
    return F.xxhash64(key), F.xxhash64(F.lit("\n"), F.reverse(key))


class LineRuns:
    """Levelled sorted runs (k1, k2, docs, lines, top) in the shared folder."""

    def __init__(self, spark: SparkSession, parts: int | None = None, fanout: int = FANOUT):
        self.spark, self.parts, self.fanout = spark, parts or common.partitions(spark), fanout
        self.levels: list[list[tuple[str, DataFrame]]] = []

    def _write(self, run: DataFrame) -> tuple[str, DataFrame]:
        path = common.scratch_path(self.spark, "line-run")
        run.repartition(self.parts, "k1").sortWithinPartitions("k1", "k2").write.parquet(path)
        return path, self.spark.read.schema(run.schema).parquet(path)

    def all(self) -> DataFrame | None:
        """The rows of all runs; a key has a row in each run that holds it."""
        runs = [run for level in self.levels for _, run in level]
        return reduce(DataFrame.union, runs) if runs else None

    def totals(self) -> DataFrame:
        """One row for each key, over all runs."""
        return _merged(self.all())

    def add(self, keys: DataFrame) -> None:
        """Add the batch (k1, k2, doc_id, one row for each key of a document, lines if it stands there more than once).

        Batches must come in descending order of doc_id. Keys that no run holds (the anti-join's) bring
        the document that keeps the line, ``top``; keys that a run holds only add their counts.
        """
        n = F.sum("lines") if "lines" in keys.columns else F.count("*")
        batch = keys.groupBy("k1", "k2").agg(F.count("*").alias("docs"), n.alias("lines"), F.max("doc_id").alias("top"))
        if (old := self.all()) is not None:
            seen = old.select("k1", "k2").distinct().withColumn("seen", F.lit(True))
            batch = batch.join(seen, ["k1", "k2"], "left").select("k1", "k2", "docs", "lines", F.when(F.col("seen").isNull(), F.col("top")).alias("top"))
        self._place(0, *self._write(batch))

    def _place(self, level: int, path: str, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((path, run))
        if len(self.levels[level]) < self.fanout:
            return
        full, self.levels[level] = self.levels[level], []
        merged = self._write(_merged(reduce(DataFrame.union, [r for _, r in full])))
        for old, _ in full:
            common.drop_path(self.spark, old)
        self._place(level + 1, *merged)


def _merged(runs: DataFrame) -> DataFrame:
    return runs.groupBy("k1", "k2").agg(F.sum("docs").alias("docs"), F.sum("lines").alias("lines"), F.max("top").alias("top"))


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, row, pos, k1, k2) of the lines whose keys are long enough; a null text is one empty line.

    ``row`` is a hash of the text, which tells rows of one id apart.
    """
    lines = docs.select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    keys = lines.where(F.length("line") >= min_chars).select("doc_id", "row", "pos", key_of(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    k1, k2 = _hash(F.col("key"))
    return keys.select("doc_id", "row", "pos", k1.alias("k1"), k2.alias("k2"))


def frequent(spark: SparkSession, lines: DataFrame, batches: int = BATCHES, min_docs: int = MIN_DOCS) -> DataFrame:
    """(k1, k2, lines, top) of the keys in at least ``min_docs`` documents, from runs built batch by batch.

    Batches are ranges of doc_id, from its quantiles, in descending order; each document is in one
    batch, null ids in the last. Rows with the same id are one document here.
    """
    cuts = lines.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    cuts = sorted(set(cuts or []), reverse=True)
    once = lines.groupBy("doc_id", "k1", "k2").agg(F.count("*").alias("lines"))
    runs = LineRuns(spark)
    high = None
    for low in [*cuts, None]:
        part = F.lit(True) if low is None else F.col("doc_id") > low
        if high is not None:
            part = part & (F.col("doc_id") <= high)
        if low is None:
            part = part | F.col("doc_id").isNull()
        runs.add(once.where(part))
        high = low
    return runs.totals().where(F.col("docs") >= min_docs).select("k1", "k2", "lines", "top")


def _kept(lines: Column, drops: Column) -> Column:
    """The lines whose positions aren't in the sorted array ``drops``: the stretches between them."""
    ends = F.concat(drops, F.array(F.size(lines)))
    starts = F.concat(F.array(F.lit(0)), F.transform(drops, lambda p: p + 1))
    return F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a)))


def deduplicated(docs: DataFrame, batches: int = BATCHES, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with _n_lines, _n_dropped and _kept, the text without the lines that other documents repeat.

    A key found in enough documents keeps its lines in the largest doc_id that holds it and loses all
    others. Null and empty texts are one empty line, which stays. Rows that share a doc_id are one
    document in the counts and each keeps its lines if that id is the largest; ids of null count
    as one document that is smaller than all, so such rows never hold the kept copy unless no other
    row has the key. Other columns stay as they are, but for those named like the three new ones, which
    are replaced. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    all_lines, gone = common.fresh(docs, "_lines", "_drops")
    lines = common.written(spark, line_keys(docs.select("doc_id", "text"), min_chars), "lines")
    hot = common.written(spark, frequent(spark, lines, batches, min_docs), "frequent-lines")
    # A key's lines go through one task of the join unless the key is broadcast.
    heavy = F.broadcast(hot.where(F.col("lines") > lines.count() * HEAVY).select("k1", "k2", "top"))
    found = lines.join(heavy, ["k1", "k2"]).union(lines.join(heavy.drop("top"), ["k1", "k2"], "left_anti").join(hot.select("k1", "k2", "top"), ["k1", "k2"]))
    lost = found.where(~F.col("doc_id").eqNullSafe(F.col("top")))
    drops = lost.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("pos")).alias(gone))
    same = F.col("d.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.xxhash64("d.text") == F.col("x.row"))
    joined = docs.alias("d").join(drops.alias("x"), same, "left").select("d.*", gone)
    split = joined.withColumn(all_lines, F.split(F.coalesce("text", F.lit("")), "\n", -1)).withColumn(gone, F.coalesce(gone, F.array().cast("array<int>")))
    text = F.when(F.size(gone) == 0, F.coalesce("text", F.lit(""))).otherwise(F.array_join(_kept(F.col(all_lines), F.col(gone)), "\n"))
    return split.withColumns({"_kept": text, "_n_lines": F.size(all_lines).cast("long"), "_n_dropped": F.size(gone).cast("long")}).drop(all_lines, gone)


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) for every row of ``docs``."""
    done = deduplicated(docs.select("doc_id", "text"))
    return done.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
hot AS (SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT k.doc_id, k.pos, k.line, coalesce(h.top <> k.doc_id, false) AS lost FROM keyed k LEFT JOIN hot h ON h.key = k.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE lost) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
