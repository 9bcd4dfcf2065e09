"""SimHash near-duplicates with pigeonring filtering.

A 64-bit fingerprint is cut into tau + 1 segments that form a ring. If two fingerprints differ in
at most tau bits, some segment starts a chain in which the first l segments differ in at most
floor(l * tau / m) bits together, for every l. For tau = 2 that is: one segment is equal, with
the next one there is at most one difference, with the last at most two. The equal segment and
one equal half of its successor make the join key (about 32 bits), the rest of the chain and the
Hamming distance are conditions of the join, so only real links leave it.

A key that more than ``dense`` different fingerprints share gets no pairwise comparison: its
fingerprints are linked through the 64 points one bit away from each and the point itself. Two
fingerprints share such a point exactly if they differ in at most two bits, so that way is exact
too and grows with their number, not its square.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packrow.llm import common, graph

#: (lowest bit, width) of the three ring segments, each with the widths of its two halves.
SEGMENTS = ((0, 22, 11), (22, 21, 10), (43, 21, 10))
SEED, WORDS, DENSE = 42, 3, 1024
#: Shingles whose bits are counted at a time, which bounds memory for very long texts.
_BLOCK = 1 << 15


def fingerprint(text: str | None, n: int = WORDS) -> int:
    """The unsigned fingerprint of one text; zero where it has no word."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= n:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    total, ones = len(words) - n + 1, np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, _BLOCK):
        upto = min(at + _BLOCK, total)
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[at:upto].tolist(), ends[at + n - 1 : upto + n - 1].tolist(), strict=True)), np.uint64, upto - at)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """``docs`` with the signed 64-bit fingerprint of its text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in common.text_slices(batches, text):
            prints = np.array([fingerprint(x) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(prints)], names=[*part.schema.names, out])

    return docs.mapInArrow(run, docs.withColumn(out, F.lit(0).cast("long")).schema)


def _segment(fp: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _keys(fp: Column) -> Column:
    """For each ring start and each half of the following segment, the key that viable chains share."""
    keys = []
    for i, (at, width, _) in enumerate(SEGMENTS):
        nat, nwidth, half = SEGMENTS[(i + 1) % len(SEGMENTS)]
        for j, (hat, hwidth) in enumerate(((nat, half), (nat + half, nwidth - half))):
            key = F.shiftleft(_segment(fp, at, width), hwidth).bitwiseOR(_segment(fp, hat, hwidth))
            keys.append(F.struct(F.lit(2 * i + j).cast("tinyint").alias("part"), key.alias("key")))
    return F.explode(F.array(*keys))


def _viable(a: Column, b: Column, part: Column) -> Column:
    """The budgets of the chain from ``part``: no difference, at most one, at most two."""
    odds = []
    for i, (at, width, _) in enumerate(SEGMENTS):
        nat, nwidth, _ = SEGMENTS[(i + 1) % len(SEGMENTS)]
        own = (part >= 2 * i) & (part < 2 * i + 2)
        odds.append(own & (F.bit_count(_segment(a.bitwiseXOR(b), at, width)) == 0) & (F.bit_count(_segment(a.bitwiseXOR(b), nat, nwidth)) <= 1))
    return reduce(lambda x, y: x | y, odds) & (F.bit_count(a.bitwiseXOR(b)) <= 2)


def links(prints: DataFrame, dense: int = DENSE) -> DataFrame:
    """Edges (a, b) between different fingerprints of the distinct column ``fp``.

    Every pair within two bits is connected by these edges, directly or, in dense keys, through
    the smallest fingerprint next to a shared point; no edge joins fingerprints farther apart
    than two bits.
    """
    keyed = prints.select("fp", _keys(F.col("fp")).alias("k")).select("fp", "k.part", "k.key")
    sizes = keyed.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = keyed.join(sizes, ["part", "key"])
    few = shared.where(F.col("n") <= dense)
    a, b = few.alias("a"), few.alias("b")
    same = (F.col("a.part") == F.col("b.part")) & (F.col("a.key") == F.col("b.key"))
    near = a.join(b, same & (F.col("a.fp") < F.col("b.fp")) & _viable(F.col("a.fp"), F.col("b.fp"), F.col("a.part")))
    near = near.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    many = shared.where(F.col("n") > dense).select("fp").distinct()
    flips = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    points = many.select("fp", F.explode(flips).alias("point"))
    hubs = points.groupBy("point").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least < most").select("point", "least")
    star = points.join(hubs, "point").where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    return near.union(star).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", dense: int = DENSE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    component_id is the smallest doc_id reachable over fingerprints within two bits. A null text
    counts as empty; texts without words share fingerprint zero and are linked like any other. A
    null doc_id never names a component unless the whole component has no other (then null).
    Repeated rows stay, each with its component. Columns of ``docs`` beside the two named ones
    aren't read. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = common.written(spark, with_fingerprint(narrow).select("doc_id", "fp"), "simhash")
    found = classes(prints, dense)
    return prints.join(found, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def classes(prints: DataFrame, dense: int = DENSE, nodes: DataFrame | None = None) -> DataFrame:
    """(fp, head, component_id) for every fingerprint of the table (doc_id, fp); head is the class's smallest fingerprint.

    ``nodes`` has (node, component) of the fps in classes of several; without it classes are those of fingerprints within two bits.
    """
    spark = prints.sparkSession
    distinct = common.written(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    nodes = (graph.components(links(distinct.select("fp"), dense)) if nodes is None else nodes).withColumnsRenamed({"node": "fp", "component": "head"})
    labelled = distinct.join(nodes, "fp", "left").withColumn("head", F.coalesce("head", "fp"))
    heads = labelled.groupBy("head").agg(F.min("least").alias("component_id"))
    return labelled.join(heads, "head").select("fp", "head", "component_id")


def keep_one(docs: DataFrame, dense: int = DENSE) -> DataFrame:
    """The rows of ``docs`` with one document of each near-duplicate component: the smallest doc_id.

    Of several texts under that id the one with the smallest hash stays, and of equal rows one. A component
    without any id keeps one of its rows. All columns of ``docs`` are kept; fingerprints are computed on whole texts,
    and only ids and hashes of texts are shuffled before the survivors are known.
    """
    spark = docs.sparkSession
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("row"))
    prints = common.written(spark, with_fingerprint(hashed).select("doc_id", "row", "fp"), "simhash")
    return survivors(docs, prints, classes(prints, dense))


def survivors(docs: DataFrame, prints: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`keep_one` keeps, from (doc_id, row, fp) of its rows and the classes of their fps."""
    heads = prints.join(found, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    chosen = heads.groupBy("head").agg(F.min(F.struct("doc_id", "row")).alias("r")).select("r.*")
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.xxhash64(f"{a}.text") == F.col(f"{b}.row"))
    rows = docs.alias("d").join(chosen.alias("c"), same("d", "c"), "left_semi").select("d.*")
    twice = prints.groupBy("doc_id", "row").agg(F.count("*").alias("n")).where("n > 1")
    single = rows.alias("s").join(twice.alias("t"), same("s", "t"), "left_anti").select("s.*")
    repeated = rows.alias("s").join(twice.alias("t"), same("s", "t"), "left_semi").select("s.*")
    one = repeated.groupBy("doc_id", F.xxhash64("text").alias("_row")).agg(F.min(F.struct(*docs.columns)).alias("_one")).select("_one.*")
    return single.union(one)
