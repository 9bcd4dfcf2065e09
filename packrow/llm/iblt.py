"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs (lines, cut again after sentence ends and at the latest after 8 words).
Every paragraph, with its number among equal ones, has a 64-bit digest, which is added to
``HASHES`` cells of a sketch: count, sum of digests, sum of check values. Subtracting two sketches cancels
what both texts share; peeling cells that hold a single digest recovers the digests in which they
differ. Where peeling stops early, both texts are sketched again with four times the cells.

The functions take many documents at once: all their cells lie in one array, so that building and
peeling are a few numpy calls for a batch.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packrow.llm import common

CELLS, HASHES, GROWTH, MAX_WORDS = 24, 3, 4, 8
_SENTENCE = re.compile(r"[^\n]*?[.!?;|](?=\s)|[^\n]+")
_A = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93))


def _mix(x: np.ndarray, k: int) -> np.ndarray:
    """A finaliser that is far from linear, so that sums of digests don't look like one digest."""
    x = (x ^ (x >> np.uint64(33))) * _A[k]
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def digests(text: str | None) -> np.ndarray:
    """The 64-bit digests of a text's paragraphs; equal ones are numbered, so all differ. Blank ones don't count."""
    seen: dict[int, int] = {}
    out = []
    for part in _SENTENCE.findall(text or ""):
        words = part.split()
        for i in range(0, len(words), MAX_WORDS):
            d = xxhash.xxh64_intdigest(" ".join(words[i : i + MAX_WORDS]))
            n = seen[d] = seen.get(d, -1) + 1
            out.append(d if n == 0 else xxhash.xxh64_intdigest(d.to_bytes(8, "little"), n))
    return np.array(out, np.uint64)


def sketch(lists: list[np.ndarray], cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, digest sums, check sums), each of shape (documents, cells). Sums wrap at 64 and 32 bits."""
    keys = np.concatenate([*lists, np.zeros(0, np.uint64)])
    who = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return _cells(keys, who, np.ones(len(keys), np.int64), len(lists), cells)


def _places(keys: np.ndarray, cells: int) -> np.ndarray:
    """One cell in each third of the sketch."""
    part = cells // HASHES
    return np.stack([(_mix(keys, k) % np.uint64(part)).astype(np.int64) + k * part for k in range(HASHES)])


def _cells(keys: np.ndarray, who: np.ndarray, sign: np.ndarray, docs: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = (_places(keys, cells) + who * cells).ravel()
    counts, sums, checks = np.zeros(docs * cells, np.int64), np.zeros(docs * cells, np.uint64), np.zeros(docs * cells, np.uint64)
    unit = sign.astype(np.uint64)
    np.add.at(counts, at, np.tile(sign, HASHES))
    np.add.at(sums, at, np.tile(keys * unit, HASHES))
    np.add.at(checks, at, np.tile((_mix(keys, 3) >> np.uint64(32)) * unit, HASHES))
    return counts.reshape(docs, cells), sums.reshape(docs, cells), (checks & np.uint64(0xFFFFFFFF)).reshape(docs, cells)


def peel(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(whole, who, digest, sign) of what differs between sketches a and b, document by document.

    ``whole`` tells for each document whether everything was recovered; sign is 1 for a digest only in a,
    -1 for one only in b.
    """
    counts, sums, checks = a[0] - b[0], a[1] - b[1], (a[2] - b[2]) & np.uint64(0xFFFFFFFF)
    docs, cells = counts.shape
    found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    live = np.arange(docs)
    for _ in range(4 * cells):
        sign = counts[live]
        key = np.where(sign < 0, np.uint64(0) - sums[live], sums[live])
        proof = np.where(sign < 0, np.uint64(0) - checks[live], checks[live]) & np.uint64(0xFFFFFFFF)
        pure = (np.abs(sign) == 1) & (proof == _mix(key, 3) >> np.uint64(32))
        row, col = np.nonzero(pure)
        if not len(row):
            break
        who, keys, signs = live[row], key[row, col], sign[row, col]
        first = _first(who, keys)
        who, keys, signs = who[first], keys[first], signs[first]
        at = (_places(keys, cells) + who * cells).ravel()
        unit = signs.astype(np.uint64)
        np.subtract.at(counts.reshape(-1), at, np.tile(signs, HASHES))
        np.subtract.at(sums.reshape(-1), at, np.tile(keys * unit, HASHES))
        np.subtract.at(checks.reshape(-1), at, np.tile((_mix(keys, 3) >> np.uint64(32)) * unit, HASHES))
        checks &= np.uint64(0xFFFFFFFF)
        for store, x in zip(found, (who, keys, signs), strict=True):
            store.append(x)
        live = np.unique(who)
    whole = ~(counts.any(axis=1) | sums.any(axis=1) | checks.any(axis=1))
    return whole, *(np.concatenate(x) for x in found)


def _first(who: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each pair of document and digest stands first."""
    order = np.lexsort((keys, who))
    w, k = who[order], keys[order]
    return order[np.concatenate([[True], (w[1:] != w[:-1]) | (k[1:] != k[:-1])])]


def differences(a: list[np.ndarray], b: list[np.ndarray], cells: int = CELLS) -> np.ndarray:
    """In how many digests each pair of texts differs, by subtracting and peeling sketches, larger until all are recovered."""
    out = np.zeros(len(a), np.int64)
    todo = np.arange(len(a))
    while len(todo):
        # Sketches of one round hold a bounded number of cells at a time.
        step, late = max(1, (1 << 19) // cells), []
        for i in range(0, len(todo), step):
            own = todo[i : i + step]
            whole, who, _, _ = peel(sketch([a[j] for j in own], cells), sketch([b[j] for j in own], cells))
            out[own] = np.bincount(who, minlength=len(own))
            late.append(own[~whole])
        todo, cells = np.concatenate(late), cells * GROWTH
    return out


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Shared digests over all digests, 0 to 1; two texts without digests are alike."""
    n = np.array([len(x) for x in a]) + np.array([len(x) for x in b])
    d = differences(a, b)
    return np.where(n + d > 0, (n - d) / np.maximum(n + d, 1), 1.0)


def fingerprints(lists: list[np.ndarray], cells: int = CELLS) -> list[str]:
    """The sketch of each text in base64: number of digests, then counts, digest sums and check sums."""
    counts, sums, checks = sketch(lists, cells)
    c, s, k = counts.astype("<i4"), sums.astype("<u8"), checks.astype("<u4")
    return [base64.b64encode(len(x).to_bytes(4, "little") + c[i].tobytes() + s[i].tobytes() + k[i].tobytes()).decode() for i, x in enumerate(lists)]


def parse(fingerprint: str) -> tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(number of digests, sketch of one document) back from a fingerprint."""
    raw = base64.b64decode(fingerprint)
    cells = (len(raw) - 4) // 16
    at = (4, 4 + 4 * cells, 4 + 12 * cells)
    parts = np.frombuffer(raw, "<i4", cells, at[0]).astype(np.int64), np.frombuffer(raw, "<u8", cells, at[1]).astype(np.uint64), np.frombuffer(raw, "<u4", cells, at[2]).astype(np.uint64)
    return int.from_bytes(raw[:4], "little"), tuple(x.reshape(1, -1) for x in parts)


def edited(text: str, following: str) -> str:
    """The text with its last half of code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def dealt(docs: DataFrame, buckets: int) -> DataFrame:
    """``docs`` (doc_id, text) by ranges of doc_id, each range with the first documents of the next as look-ahead.

    Ranges end at document ids from the table's quantiles. Sorted by range, then id from large to small,
    then text; rows with role 1 only lend their text to the last row of their range. The largest id follows
    the last row of all. Null ids come last.
    """
    most, cuts = docs.agg(F.max("doc_id"), F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 100 * buckets)).first() if buckets > 1 else (*docs.agg(F.max("doc_id")).first(), None)
    cuts = sorted(set(cuts or []) - {most}, reverse=True)
    edge = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    # Range r holds cuts[r - 1] >= id > cuts[r]; the largest id in range r is cuts[r - 1] itself.
    place = F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(F.size(F.filter(edge, lambda c: F.col("doc_id") <= c)))
    d = docs.withColumn("bucket", place.cast("int"))
    first = F.col("doc_id").isin(cuts) if cuts else F.lit(False)
    wrap = F.col("doc_id").eqNullSafe(F.lit(most).cast("long"))
    own = F.struct(F.col("bucket"), F.lit(0).alias("role"))
    ahead = F.when(first, F.struct((F.col("bucket") - 1).alias("bucket"), F.lit(1).alias("role")))
    around = F.when(wrap, F.struct(F.lit(len(cuts)).alias("bucket"), F.lit(2).alias("role")))
    rows = d.withColumn("to", F.explode(F.array_compact(F.array(own, ahead, around)))).select("to.bucket", "to.role", "doc_id", "text")
    deal = F.get(F.array(*[F.lit(k) for k in common.dealt_keys(buckets).tolist()]), F.col("bucket"))  # a partition for each
    return rows.withColumn("deal", deal).repartition(buckets, "deal").drop("deal").sortWithinPartitions("bucket", "role", F.col("doc_id").desc_nulls_last(), F.col("text").desc_nulls_last())


def compared(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The next document is the one below in descending doc_id, after the last the first; rows of one id
    follow each other by descending text, null ids come after all others. A single row is its own next.
    A null text is empty. The texts are shuffled once, by ranges of doc_id.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def chunk(ids: list, texts: list[str], following: list[str], lists: list, next_lists: list) -> pa.RecordBatch:
        made = [edited(a, b) for a, b in zip(texts, following, strict=True)]
        own = [digests(x) for x in made]
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([len(x) for x in texts], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in made], pa.string()),
            pa.array(fingerprints(lists), pa.string()), pa.array(fingerprints(own), pa.string()), pa.array(likeness(lists, own), pa.float64()), pa.array(likeness(lists, next_lists), pa.float64()),
        ], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (id, text, digests) of the range so far that lack their next
        bucket, looked = None, None

        def settle(last: tuple | None) -> Iterator[pa.RecordBatch]:
            rows = held + ([last] if last else [])
            if len(rows) > 1:
                yield chunk([r[0] for r in rows[:-1]], [r[1] for r in rows[:-1]], [r[1] for r in rows[1:]], [r[2] for r in rows[:-1]], [r[2] for r in rows[1:]])

        def finish() -> Iterator[pa.RecordBatch]:
            if held:
                yield from settle(looked if looked else held[-1])
            held.clear()

        for part, texts in common.text_slices(batches):
            for b, role, i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), texts, strict=True):
                if b != bucket:
                    yield from finish()
                    bucket, looked = b, None
                if role:
                    looked = looked or (i, text, digests(text))  # role 1 stands before role 2
                    continue
                held.append((i, text, digests(text)))
                if len(held) > common.SLICE_ROWS:
                    yield from settle(None)
                    del held[:-1]
        yield from finish()

    return dealt(narrow, buckets or common.partitions(spark)).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
