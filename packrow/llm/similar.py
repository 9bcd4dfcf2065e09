"""Near-duplicates by similarity: classes of documents whose sets of 5-word shingles have a Jaccard similarity of 0.8.

SimHash comes first: :func:`simhash.links` finds the fingerprints (of 5-word shingles) within two bits by its pigeonring
chains, and the links whose sets are similar by exact comparison make the first classes. Similar sets can differ in more
bits than the segments of a 64-bit ring can serve as keys for, so what those classes leave apart goes on to a join of the sets:

Any two similar sets share k shingles among the first n - ceil(0.8 n) + k of each, n being its own size, under any
one order of all shingles; k is a twentieth of the smaller size. Those shingles are the join keys, so no pair is
missed; pairs that share k keys are compared exactly, if their sketches are near enough to be of similar sets. The order puts shingles in crowded hash buckets last, which only saves work.

A key of over ``DENSE`` sets is not compared pairwise but with pivots, in rounds with ever more of them, which
are drawn from the sets outside the key's largest class. A key is done when all its sets that were no
pivot are in one class; until then every pair of different classes gets compared that can share k dense keys, as
both have so many. Where one has fewer, a similar pair shares the others of its k in keys that are not dense, and is found there.

Shingles and sets stand for themselves by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packrow.llm import common, graph, simhash, windows

WORDS, PERCENT, DENSE, PIVOTS, SEED = 5, 80, 128, 32, 42
#: Shingles are counted in so many buckets for the order.
_BUCKETS = 1 << 18
#: Of so many shingles of a set one must be a common key.
_EVERY = 20
#: Bits of a set's sketch.
_BITS = 512
#: So many sets at most are looked up by broadcast, some 60 bytes each, and so many links are put together in the driver.
_BROADCAST = 100_000


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Ascending hashes of the different shingles; a text of fewer words is one, a text of none has none."""
    found = (text or "").encode().lower().split()
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED)] if found else [], np.uint64)
    one = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    out = one
    for k in range(1, words):
        out = windows._joined(out, one, k)
    return np.unique(out)


def keys_of(shingle: np.ndarray, late: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The shingles of one set, of which any similar set has enough among its own; ``late`` ranks the buckets."""
    n = len(shingle)
    order = np.argsort(late[(shingle % np.uint64(_BUCKETS)).astype(np.int64)], kind="stable")
    return shingle[order[: n + (-percent * n // 100) + max(1, n // _EVERY) if n else 0]]


def sketch(shingle: np.ndarray) -> np.ndarray:
    """Bits that are set where an odd number of shingles falls on them. Two sketches differ in no more bits than their sets in shingles."""
    odd = np.bincount((shingle >> np.uint64(32)).astype(np.int64) % _BITS, minlength=_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _ranks(docs: DataFrame, words: int) -> np.ndarray:
    """For each bucket 0, or its count where that stands out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_BUCKETS, np.int64)
        for _, texts in common.text_slices(batches):
            found = np.concatenate([shingles(x, words) for x in texts])
            total += np.bincount((found % np.uint64(_BUCKETS)).astype(np.int64), minlength=_BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    counts = common.written(docs.sparkSession, docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")), "similar-order")
    mean = (counts.agg(F.sum("n")).first()[0] or 0) / _BUCKETS
    late = np.zeros(_BUCKETS, np.int64)
    for r in counts.where(F.col("n") > mean + 8 * mean**0.5 + 8).collect():
        late[r.bucket] = r.n
    return late


def with_keys(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, row, fp, n, simhash, keys, sketch): a hash of the text, one of its set of shingles, the set's size, the text's SimHash, the set's keys and sketch."""
    late = _ranks(docs, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in common.text_slices(batches):
            sets = [shingles(x, words) for x in texts]
            prints = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            bitwise = np.array([simhash.fingerprint(x, words) for x in texts], np.uint64).view(np.int64)
            keys = pa.array([keys_of(s, late, percent).view(np.int64) for s in sets], pa.list_(pa.int64()))
            bits = pa.array([sketch(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(prints), pa.array([len(s) for s in sets], pa.int64()), pa.array(bitwise), keys, bits], names=["doc_id", "row", "fp", "n", "simhash", "keys", "sketch"])

    narrow = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
    longs = F.array().cast("array<long>")
    return narrow.mapInArrow(run, narrow.select("doc_id", "row", F.lit(0).cast("long").alias("fp"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("simhash"), longs.alias("keys"), longs.alias("sketch")).schema)


def _sets(docs: DataFrame, prints: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(fp, shingles) of the wanted fps, from one text of each. Few fps are looked up by broadcast, so that no other text is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in common.text_slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(x, words).view(np.int64) for x in texts], pa.list_(pa.int64()))], names=["fp", "shingles"])

    few = F.broadcast if wanted.count() <= _BROADCAST else lambda x: x
    rows = common.written(docs.sparkSession, prints.select("fp", "row").join(few(wanted), "fp").groupBy("fp").agg(F.min("row").alias("row")), "similar-rows")
    texts = docs.select(F.xxhash64("text").alias("row"), "text").join(few(rows), "row").select("fp", "text").groupBy("fp").agg(F.min("text").alias("text"))
    return texts.mapInArrow(run, "fp long, shingles array<long>")


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _similar(docs: DataFrame, prints: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar; only the sets of shingles they name are made."""
    spark = docs.sparkSession
    wanted = common.written(spark, pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "similar-wanted")
    # Dealt by fp once; both joins read the same shuffle.
    sets = _sets(docs, prints, wanted, words).repartition(common.partitions(spark), "fp")
    left, right = sets.select(F.col("fp").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("fp").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    close = pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")
    close = common.written(spark, close, "similar-edges")
    common.swept(spark)
    return close


def _near(prints: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches differ in no more bits than similar sets of their sizes may differ in shingles.

    This needs 64 bytes of a set; it is sharp for sets of up to some 1000 shingles, and pairs of longer ones pass.
    """
    sets = prints.select("fp", "n", "sketch").dropDuplicates(["fp"])
    left, right = (sets.select(F.col("fp").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
    apart = reduce(add, (F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i])) for i in range(_BITS // 64)))
    both = pairs.join(left, "a").join(right, "b")
    return both.where((100 + percent) * apart <= (100 - percent) * (F.col("na") + F.col("nb"))).select("a", "b")


def _needed(a: Column, b: Column) -> Column:
    """How many keys a similar pair of sets of these sizes shares at least."""
    return F.greatest(F.lit(1), F.floor(F.least(a, b) / _EVERY))


def _elsewhere(needed: Column, crowded: Column) -> Column:
    """How many of the needed keys a similar pair shares outside dense ones, ``crowded`` being the fewer dense keys of the two.

    With enough dense keys the pair is compared at any of them it shares; if it shares none, all are outside.
    """
    return F.when(crowded >= needed, needed).otherwise(needed - crowded)


def _sharing(prints: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs that share enough of all their keys: a fraction of what comparing whole sets moves."""
    spark = prints.sparkSession
    wanted = common.written(spark, pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "similar-wanted")
    few = F.broadcast if wanted.count() <= _BROADCAST else lambda x: x
    sets = prints.select("fp", "n", "keys").join(few(wanted), "fp").dropDuplicates(["fp"])
    left, right = (sets.select(F.col("fp").alias(x), F.col("n").alias(f"n{x}"), F.col("keys").alias(f"k{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b")
    return both.where(F.size(F.array_intersect("ka", "kb")) >= _needed(F.col("na"), F.col("nb"))).select("a", "b")


def ring_pairs(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of fps that connect those with equal SimHash fingerprints, and these by their pigeonring links."""
    spark = prints.sparkSession
    heads = common.written(spark, prints.groupBy("simhash").agg(F.min("fp").alias("head")), "similar-simhash")
    same = prints.select("fp", "simhash").distinct().join(heads, "simhash").select(F.col("head").alias("a"), F.col("fp").alias("b"))
    left, right = (heads.select(F.col("simhash").alias(x), F.col("head").alias(f"h{x}")) for x in "ab")
    near = simhash.links(heads.select(F.col("simhash").alias("fp"))).join(left, "a").join(right, "b")
    near = near.select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b"))
    return common.written(spark, same.union(near).where("a <> b").distinct(), "similar-ring")


def _classed(rows: DataFrame, nodes: DataFrame, fp: str = "fp", out: str = "class") -> DataFrame:
    """``rows`` with the class of a column of fps; one without links is its own."""
    return rows.join(nodes.select(F.col("node").alias(fp), F.col("component").alias(out)), fp, "left").withColumn(out, F.coalesce(out, fp))


def links(docs: DataFrame, prints: DataFrame, words: int = WORDS, percent: int = PERCENT, dense: int = DENSE, pivots: int = PIVOTS) -> DataFrame:
    """(node, component) of the fps that are similar to others: the smallest fp of the class, by all similar pairs."""
    spark = docs.sparkSession

    def joined(nodes: DataFrame | None, pairs: DataFrame) -> DataFrame:
        """(node, component) after the pairs that are similar. With nothing new the classes stay."""
        new = None if pairs.isEmpty() else _similar(docs, prints, pairs, words, percent)
        if nodes is not None and (new is None or new.isEmpty()):
            return nodes
        old = spark.createDataFrame([], "a long, b long") if nodes is None else nodes.select(F.col("component").alias("a"), F.col("node").alias("b"))
        edges = old if new is None else old.union(new)
        found = graph.few_components(edges) if edges.count() <= _BROADCAST else graph.components(edges)
        found = common.written(spark, found, "similar-classes")
        common.swept(spark)
        return found

    ring = common.written(spark, _near(prints, ring_pairs(prints), percent), "similar-pairs")
    common.swept(spark)
    nodes = joined(None, ring)
    keyed = prints.select("fp", "n", "keys").dropDuplicates(["fp"]).select("fp", "n", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
    shared = common.written(spark, keyed.join(sizes, "key"), "similar-keys")
    common.swept(spark)
    crowded = shared.where(F.col("many") > dense).groupBy("fp").agg(F.count("*").alias("crowded"))
    crowded = common.written(spark, crowded, "similar-crowded")
    looked = F.broadcast if crowded.count() <= _BROADCAST else lambda x: x
    few = shared.where(F.col("many") <= dense).join(looked(crowded), "fp", "left").withColumn("crowded", F.coalesce("crowded", F.lit(0)))
    a, b = few.alias("a"), few.alias("b")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & _sizes_fit(F.col("a.n"), F.col("b.n"), percent))
    needed = _elsewhere(_needed(F.col("a.n"), F.col("b.n")), F.least("a.crowded", "b.crowded"))
    pairs = met.groupBy(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).agg(F.count("*").alias("keys"), F.min(needed).alias("needed")).where("keys >= needed").select("a", "b")
    apart = _classed(_classed(common.written(spark, pairs, "similar-met"), nodes, "a", "ca"), nodes, "b", "cb").where("ca <> cb").select("a", "b")
    pairs = common.written(spark, _near(prints, apart, percent), "similar-pairs")
    common.swept(spark)
    nodes = joined(nodes, pairs)
    # Sets with fewer dense keys than they would share with the smallest similar set have met theirs above.
    able = F.col("crowded") >= _needed(F.ceil(percent * F.col("n") / 100), F.col("n"))
    left = shared.where(F.col("many") > dense).join(looked(crowded), "fp").where(able).select("key", "fp", "n", "crowded")
    everyone, turn = left, 0
    while not left.isEmpty():
        counts = _classed(left, nodes).groupBy("key", "class").agg(F.count("*").alias("n"))
        major = counts.groupBy("key").agg(F.max(F.struct("n", "class")).alias("top"), F.sum("n").alias("all")).select("key", F.col("top.class").alias("major"), (F.col("all") - F.col("top.n")).alias("minor")).where("minor > 0")
        open_ = common.written(spark, _classed(left, nodes).join(major, "key"), "similar-open")
        if open_.isEmpty():
            break
        step = F.ceil(F.col("minor") / (pivots << 2 * turn))
        drawn = (F.col("class") != F.col("major")) & (F.pmod(F.xxhash64("fp", F.lit(turn)), step) == 0)
        p, o = open_.where(drawn).alias("p"), _classed(everyone, nodes).alias("o")
        able = F.least("p.crowded", "o.crowded") >= _needed(F.col("p.n"), F.col("o.n"))
        met = p.join(o, (F.col("p.key") == F.col("o.key")) & (F.col("p.class") != F.col("o.class")) & _sizes_fit(F.col("p.n"), F.col("o.n"), percent) & able)
        pairs = met.select(F.least("p.fp", "o.fp").alias("a"), F.greatest("p.fp", "o.fp").alias("b"))
        pairs = common.written(spark, pairs.distinct(), "similar-met")
        pairs = common.written(spark, _near(prints, pairs, percent), "similar-near")
        common.swept(spark)
        if pairs.count() > _BROADCAST:
            pairs = common.written(spark, _sharing(prints, pairs), "similar-pairs")
            common.swept(spark)
        nodes = joined(nodes, pairs)
        left, turn = open_.where(~drawn).select("key", "fp", "n", "crowded"), turn + 1
    return nodes


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, dense: int = DENSE) -> DataFrame:
    """The rows of ``docs`` with one document of each class of similar ones: the one that :func:`simhash.keep_one` would keep of it."""
    prints = common.written(docs.sparkSession, with_keys(docs, words, percent), "similar")
    return simhash.survivors(docs, prints, simhash.classes(prints, nodes=links(docs, prints, words, percent, dense)))
