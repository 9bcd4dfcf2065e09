"""Substring dedup: a log-structured index of window fingerprints.

1. Every batch of documents (ascending ranges of doc_id) gives a run: for each anchor of its windows
   (see :mod:`windows`) the hash, the hash of the context in which it stands (all words of the windows that
   share it), the block of documents and the smallest doc_id. Runs are immutable bucketed Parquet
   tables, sorted by hash; equal buckets of two runs merge-join without a shuffle. ``Index.compact``
   merges runs; a query never calls it, because its two runs are joined once and then not used again.
   There is no entry that deduplicates a later batch against an index that was kept.
2. Joining the runs tells which anchors occur twice, in which blocks, and for each context the document
   that has it first. Every block of documents gets its own hits. Windows of a context that an
   earlier document (or an earlier place) holds whole are marked there, where the 64-bit context hashes are equal.
3. Where an anchor has several contexts, the windows of each context's first occurrence are compared
   one by one in the same way, and only documents with such windows are read again.

No key gathers its occurrences: rows are combined by key and block before they are shuffled, and
decisions go back to the blocks.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packrow.llm import common, windows

BATCHES, LAST = 2, (1 << 63) - 1
#: Text bytes of a block of documents, which one task judges.
BLOCK_BYTES = 16_000_000
#: Anchors that a task combines at a time.
_HELD = 150_000
_RUN = "h long, a long, block int, doc long, n int"
_OUT = "kind int, block int, doc_id long, none boolean, n_words long, n_removed long, kept_sha256 string, blob binary, marks binary, h long, w long, n int"


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


class Stretches:
    """One text: its words, windows, and the stretches of windows that share an anchor."""

    def __init__(self, text: str):
        self.words = text.encode().split()
        self.n_windows = max(0, len(self.words) - windows.SIZE + 1)
        if self.n_windows:
            grams, self.windows = windows.hashes(self.words)
            self.first, at = windows.anchors(grams, self.n_windows)
            self.count = np.diff(np.append(self.first, self.n_windows))
            self.anchor = grams[at]
            self.context = windows.context(self.windows, self.first, self.count)

    def result(self, marks: np.ndarray) -> tuple[int, int, str]:
        """(words, removed words, digest of the kept ones) where the marked windows go."""
        if not self.n_windows or not marks.any():
            return len(self.words), 0, hashlib.sha256(b" ".join(self.words)).hexdigest()
        edge = np.zeros(len(self.words) + 1, np.int64)
        at = np.flatnonzero(marks)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + windows.SIZE, -1)
        gone = np.cumsum(edge[:-1]) > 0
        kept = [w for w, g in zip(self.words, gone.tolist(), strict=True) if not g]
        return len(self.words), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()


def _combined(block: np.ndarray, h: np.ndarray, a: np.ndarray, doc: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """One row for each block, hash and context: the smallest document, and 1 or 2 for once or more."""
    order = np.lexsort((doc, a, h, block))
    block, h, a, doc, n = block[order], h[order], a[order], doc[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (a[1:] != a[:-1]) | (block[1:] != block[:-1])]))
    total = np.minimum(np.add.reduceat(n, new), 2)
    return pa.RecordBatch.from_arrays([_signed(h[new]), _signed(a[new]), pa.array(block[new].astype(np.int32)), pa.array(doc[new]), pa.array(total.astype(np.int32))], names=["h", "a", "block", "doc", "n"])


def anchor_rows(docs: DataFrame, ranges: common.Blocks) -> DataFrame:
    """The rows of a run (h, a, block, doc, n), combined within each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for part, texts in common.text_slices(batches):
            for doc, block, text in zip(part.column(0).to_pylist(), ranges.of(part.column(0)).tolist(), texts, strict=True):
                s = Stretches(text)
                if s.n_windows:
                    k = len(s.first)
                    held.append((np.full(k, block), s.anchor, s.context, np.full(k, doc, np.int64), np.ones(k, np.int64)))
                    size += k
            if size >= _HELD:
                yield _combined(*map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
        if held:
            yield _combined(*map(np.concatenate, zip(*held, strict=True)))

    return docs.mapInArrow(run, _RUN)


class Index:
    """Sorted immutable runs of anchors in the shared folder, all in the same buckets."""

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.spark, self.buckets, self.runs = spark, buckets or common.partitions(spark), []

    def add(self, rows: DataFrame) -> None:
        """Write one run; a batch's documents must not precede those of earlier batches."""
        name = f"packrow_run_{uuid.uuid4().hex}"
        dealt = rows.repartition(self.buckets, "h").sortWithinPartitions("h")
        dealt.write.format("parquet").option("path", common.scratch_path(self.spark, "window-run")).option("parquet.writer.version", "PARQUET_2_0").bucketBy(self.buckets, "h").sortBy("h").saveAsTable(name)
        self.runs.append(name)

    def compact(self) -> None:
        """Merge all runs into one and forget the old ones."""
        old, self.runs = self.runs, []
        self.add(reduce(DataFrame.union, [self.spark.table(x) for x in old]))
        for name in old:
            self.spark.sql(f"DROP TABLE {name}")

    def hits(self) -> DataFrame:
        """(block, h, a, first, many): for each repeated anchor and each block that has it, its contexts there.

        ``first`` is the smallest document with the context, ``many`` tells whether the anchor has other contexts.
        All aggregates and joins work bucket by bucket.
        """
        per_h, per_a = [], []
        for name in self.runs:
            t = self.spark.table(name)
            per_h.append(t.groupBy("h").agg(F.sum("n").alias("n"), F.min("a").alias("low"), F.max("a").alias("high")))
            per_a.append(t.groupBy("h", "a").agg(F.min("doc").alias("first"), F.collect_set("block").alias("blocks")))
        totals = reduce(lambda x, y: x.alias("x").join(y.alias("y"), F.col("x.h") == F.col("y.h"), "full").select(F.coalesce("x.h", "y.h").alias("h"), (F.coalesce("x.n", F.lit(0)) + F.coalesce("y.n", F.lit(0))).alias("n"), F.least("x.low", "y.low").alias("low"), F.greatest("x.high", "y.high").alias("high")), per_h)
        same = (F.col("x.h") == F.col("y.h")) & (F.col("x.a") == F.col("y.a"))
        empty = F.array().cast("array<int>")
        contexts = reduce(lambda x, y: x.alias("x").join(y.alias("y"), same, "full").select(F.coalesce("x.h", "y.h").alias("h"), F.coalesce("x.a", "y.a").alias("a"), F.least("x.first", "y.first").alias("first"), F.array_union(F.coalesce("x.blocks", empty), F.coalesce("y.blocks", empty)).alias("blocks")), per_a)
        rep = totals.where("n > 1").select("h", (F.col("low") != F.col("high")).alias("many"))
        return contexts.join(rep, "h").select(F.explode("blocks").alias("block"), "h", "a", "first", "many")


def _packed(docs: DataFrame, ranges: common.Blocks) -> DataFrame:
    """Documents as (block, kind 1, k1 doc, k2, k3, flag null id, blob compressed text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for part, texts in common.text_slices(batches):
            doc = part.column(0).to_numpy(zero_copy_only=False)
            zero = np.zeros(len(doc), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ranges.of(part.column(0))), pa.array(zero.astype(np.int32) + 1), pa.array(doc), pa.array(zero), pa.array(zero), part.column(1), pa.array([squeeze.compress(x.encode()) for x in texts], pa.binary())], names=["block", "kind", "k1", "k2", "k3", "flag", "blob"])

    return docs.mapInArrow(run, "block int, kind int, k1 long, k2 long, k3 long, flag boolean, blob binary")


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of hits and documents: finished results, documents to read again, and the windows to compare for them."""
    expand = zstandard.ZstdDecompressor()
    block, parts, hits = None, [], None
    for batch in batches:
        kinds, blocks = batch.column(1).to_numpy(), batch.column(0).to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], (kinds[1:] != kinds[:-1]) | (blocks[1:] != blocks[:-1])]))
        for start, end in zip(edges.tolist(), [*edges[1:].tolist(), len(kinds)], strict=True):
            part = batch.slice(start, end - start)
            if blocks[start] != block:
                block, parts, hits = blocks[start], [], None
            if kinds[start] == 0:
                parts.append(tuple(part.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4, 5)))
                continue
            if hits is None:
                hits = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]
                hits[0], hits[1] = hits[0].view(np.uint64), hits[1].view(np.uint64)
                keys = windows._mix(hits[0] * windows._A + hits[1])
                by = np.argsort(keys)
                hits, keys = [x[by] for x in hits], keys[by]
                parts = []
            for i in range(0, part.num_rows, 64):
                yield from _judged(part.slice(i, 64), int(block), hits, keys, expand)


def _judged(part: pa.RecordBatch, block: int, hits: list, keys: np.ndarray, expand: zstandard.ZstdDecompressor) -> Iterator[pa.RecordBatch]:
    rows, out = [], []
    for doc, none, blob in zip(part.column(2).to_pylist(), part.column(5).to_pylist(), part.column(6).to_pylist(), strict=True):
        s = Stretches(expand.decompress(blob).decode() if blob else "")
        marks = np.zeros(s.n_windows, bool)
        pending = None
        if s.n_windows and len(keys):
            own = windows._mix(s.anchor * windows._A + s.context)
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            hit = (keys[at] == own) & (hits[0][at] == s.anchor) & (hits[1][at] == s.context)
            # The first of a context in this document is the earliest of all if no smaller document has it.
            earliest = np.zeros(len(own), bool)
            earliest[np.unique(own, return_index=True)[1]] = True
            head = hit & earliest & (hits[2][at] == doc)
            marks = np.repeat(hit & ~head, s.count)
            open_ = np.repeat(head & hits[3][at], s.count)
            if open_.any():
                anchors, found = np.repeat(s.anchor, s.count)[open_], s.windows[open_]
                found, index, n = np.unique(found, return_index=True, return_counts=True)
                pending = anchors[index], found, np.minimum(n, 2)
        if pending is None:
            rows.append((0, block, doc, none, *s.result(marks), None, None))
        else:
            rows.append((1, block, doc, none, None, None, None, blob, np.packbits(marks).tobytes()))
            out.append((*pending, np.full(len(pending[0]), doc, np.int64)))
    if rows:
        cols = list(zip(*rows, strict=True))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary())
        no = len(rows)
        yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), pa.nulls(no, pa.int64()), pa.nulls(no, pa.int64()), pa.nulls(no, pa.int32())], names=[x.split()[0] for x in _OUT.split(", ")])
    if out:
        anchors, found, n, doc = (np.concatenate(x) for x in zip(*out, strict=True))
        no = len(doc)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(no, 2, np.int32)), pa.array(np.full(no, block, np.int32)), pa.array(doc), pa.nulls(no, pa.bool_()), pa.nulls(no, pa.int64()), pa.nulls(no, pa.int64()), pa.nulls(no, pa.string()), pa.nulls(no, pa.binary()), pa.nulls(no, pa.binary()), _signed(anchors), _signed(found), pa.array(n.astype(np.int32))], names=[x.split()[0] for x in _OUT.split(", ")])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of repeated windows (kind 0: h, w, first) and documents left open (kind 1): their results."""
    expand = zstandard.ZstdDecompressor()
    block, parts, known = None, [], None
    for batch in batches:
        kinds, blocks = batch.column(1).to_numpy(), batch.column(0).to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], (kinds[1:] != kinds[:-1]) | (blocks[1:] != blocks[:-1])]))
        for start, end in zip(edges.tolist(), [*edges[1:].tolist(), len(kinds)], strict=True):
            part = batch.slice(start, end - start)
            if blocks[start] != block:
                block, parts, known = blocks[start], [], None
            if kinds[start] == 0:
                parts.append(tuple(part.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4)))
                continue
            if known is None:
                known = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 3
                known = [known[0].view(np.uint64), known[1].view(np.uint64), known[2]]
                keys = windows._mix(known[0] * windows._A + known[1])
                by = np.argsort(keys)
                known, keys, parts = [x[by] for x in known], keys[by], []
            rows = []
            for doc, none, blob, packed in zip(*(part.column(i).to_pylist() for i in (2, 5, 6, 7)), strict=True):
                s = Stretches(expand.decompress(blob).decode())
                marks = np.unpackbits(np.frombuffer(packed, np.uint8), count=s.n_windows).astype(bool)
                if len(keys):
                    own = windows._mix(np.repeat(s.anchor, s.count) * windows._A + s.windows)
                    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    hit = (keys[at] == own) & (known[1][at] == s.windows)
                    earliest = np.zeros(len(own), bool)
                    earliest[np.unique(own, return_index=True)[1]] = True
                    marks |= hit & ~(earliest & (known[2][at] == doc))
                rows.append((None if none else doc, *s.result(marks)))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def deduplicated(docs: DataFrame, batches: int = BATCHES, blocks: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of ``docs``.

    A word goes if a window of 20 words that covers it also starts earlier: in a smaller doc_id, or in the same
    document before. Rows that share a doc_id are judged each for itself against smaller ids; ids of null
    come after all others and count as one id. Null texts and texts without words keep nothing and lose nothing.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.col("doc_id").isNull().alias("none"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = common.Blocks(narrow, BLOCK_BYTES, blocks)
    cuts = ranges.edges.tolist()
    index, low = Index(spark), None
    for k in range(batches):
        high = cuts[(k + 1) * len(cuts) // batches] if k + 1 < batches and cuts else None
        part = F.lit(True) if low is None else F.col("doc_id") >= low
        index.add(anchor_rows(narrow.where(part if high is None else part & (F.col("doc_id") < high)).select("doc_id", "text"), ranges))
        if high is None:
            break
        low = high
    loose, key = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition"), "spark.sql.requireAllClusterKeysForCoPartition"
    spark.conf.set(key, "false")  # buckets by h serve joins on (h, a)
    try:
        hits = index.hits().select("block", F.lit(0).alias("kind"), F.col("h").alias("k1"), F.col("a").alias("k2"), F.col("first").alias("k3"), F.col("many").alias("flag"), F.lit(None).cast("binary").alias("blob"))
        rows = hits.union(_packed(narrow.select("doc_id", "none", "text"), ranges)).repartition(ranges.n, "block").sortWithinPartitions("block", "kind")
        judged = common.written(spark, rows.mapInArrow(_judge, _OUT), "judged")
    finally:
        spark.conf.set(key, loose)
    again = judged.where("kind = 2").groupBy("h", "w").agg(F.min("doc_id").alias("first"), F.sum("n").alias("n"), F.collect_set("block").alias("blocks")).where("n > 1")
    again = again.select(F.explode("blocks").alias("block"), F.lit(0).alias("kind"), F.col("h").alias("k1"), F.col("w").alias("k2"), F.col("first").alias("k3"), F.lit(None).cast("boolean").alias("flag"), F.lit(None).cast("binary").alias("blob"), F.lit(None).cast("binary").alias("marks"))
    left = judged.where("kind = 1").select("block", F.lit(1).alias("kind"), F.col("doc_id").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(0).cast("long").alias("k3"), F.col("none").alias("flag"), "blob", "marks")
    settled = again.union(left).repartition(ranges.n, "block").sortWithinPartitions("block", "kind").mapInArrow(_settle, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    finished = judged.where("kind = 0").select(F.when(~F.col("none"), F.col("doc_id")).alias("doc_id"), "n_words", "n_removed", "kept_sha256")
    return finished.union(settled)


ORACLE = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM texts),
starts AS (SELECT doc_id, pos, array_to_string(list_slice(ws, pos, pos + 19), ' ') AS seq FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS pos FROM texts WHERE len(ws) >= 20)),
firsts AS (SELECT seq, min((doc_id, pos)) AS f FROM starts GROUP BY seq HAVING count(*) > 1),
dups AS (SELECT s.doc_id, s.pos FROM starts s JOIN firsts f ON s.seq = f.seq WHERE (s.doc_id, s.pos) > f.f),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM dups, (SELECT unnest(range(0, 20)) AS k)),
kept AS (SELECT w.doc_id, count(*) FILTER (WHERE g.pos IS NOT NULL) AS n_removed, string_agg(w.word, ' ' ORDER BY w.pos) FILTER (WHERE g.pos IS NULL) AS rest
  FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.pos = w.pos GROUP BY w.doc_id)
SELECT t.doc_id, CAST(len(t.ws) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.rest, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON k.doc_id = t.doc_id
"""
