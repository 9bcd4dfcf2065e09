"""Token ids in binary form: frequency-ranked ids, byte-aligned variable length, separate control bytes.

The commonest id of the corpus gets rank 0, the next rank 1. A block holds the ranks of some whole
documents: for every four ranks one control byte with their lengths (two bits each, 1 to 4 bytes),
and apart from those the ranks' bytes, lowest first. Decoding looks the control bytes up in a table of
lengths and gathers bytes with numpy.

A store is a folder with two Parquet tables, so that writing, retries and reading are Spark's:
``blocks`` (file, block, at, doc_ids, lengths, control, data) and ``ranks`` (rank, id). Files cover ascending
ranges of doc_id, and their blocks ascend too.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packrow.llm import common

END_ID, BLOCK_TOKENS, _ROWS = 2, 1 << 16, 1024
#: Words of each of two generations of the cache, their most characters (some 250 bytes a word with its ids, so 250 MB
#: for a worker), runs of marks kept, and words encoded in one string.
_CACHE_WORDS, _CACHE_CHARS, _CACHE_STOPS, _JOINED = 500_000, 64, 10_000, 500
_STOPS = ".,!?;:|*$%&#)"
_TWO_BLANKS, _CUTS = re.compile(r"\s\s"), re.compile(r"(?<=\S)(?= \S)")
#: White space besides the blank and the line end; few texts have any.
_OTHER_BLANKS = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace() and c not in " \n"]
_BLOCKS = "file int, block int, at long, doc_ids array<long>, lengths array<int>, control binary, data binary"


class Encoder:
    """Encodes whole texts with a byte-level BPE of the tokenizers library; common words come from a bounded cache.

    Such a tokenizer cuts a text before every blank between two other characters, and around a line
    end between two others, before it merges anything. So a text can be encoded word by word there.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        (self.line_end,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.stops: dict[str, bytes] = {}
        self.skip = len(np.array([self.line_end], np.uint32).tobytes())
        vocabulary = self.tokenizer.get_vocab()
        self.blank_first = np.zeros(max(vocabulary.values()) + 1, bool)
        self.blank_first[[i for t, i in vocabulary.items() if t[:1] == "\u0120"]] = True  # how the blank's byte is written

    @staticmethod
    def _words(text: str) -> list[str]:
        """Stretches that can be encoded alone. Those after a line end start with it, the others with their blank left out."""
        return ("\n" + text).replace("\n", " \n").split(" ")[1:]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_joined(self, words: list[str], separator: str) -> list[bytes]:
        """Ids of each letter-and-digit word behind the separator, from strings of many: a token that begins with it begins a word."""
        out: list[bytes] = []
        chunks = [words[i : i + _JOINED] for i in range(0, len(words), _JOINED)]
        for chunk, e in zip(chunks, self.tokenizer.encode_batch_fast([separator + separator.join(c) for c in chunks], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            starts = (np.flatnonzero(self.blank_first[ids] if separator == " " else ids == self.line_end) * ids.itemsize).tolist()
            raw = ids.tobytes()
            found = [raw[a:b] for a, b in zip(starts, [*starts[1:], len(raw)], strict=True)]
            if len(found) != len(chunk):
                raise ValueError("this tokenizer doesn't cut before every blank")
            out += found
        return out

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if w.isalnum()]
        first = [w for w in words if w[:1] == "\n" and w[1:].isalnum()]
        rest = [w for w in words if not (w[1:] if w[:1] == "\n" else w).isalnum()]
        self.known.update(zip(plain, self._encode_joined(plain, " "), strict=True))
        self.known.update(zip(first, self._encode_joined([w[1:] for w in first], "\n"), strict=True))
        self.known.update(zip(rest, self._encode([w if w[:1] == "\n" else " " + w for w in rest]), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as the tokenizer gives them for the whole of it."""
        if len(self.known) > _CACHE_WORDS:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        odd = [("  " in x or "\n\n" in x or "\n " in x or " \n" in x or any(c in x for c in _OTHER_BLANKS)) and bool(_TWO_BLANKS.search(x)) for x in texts]
        lists = [[] if o else self._words(x) for x, o in zip(texts, odd, strict=True)]

        def unknown(words: set[str]) -> set[str]:
            new = words.difference(known)
            found = [w for w in new if w in before]
            known.update(zip(found, map(before.__getitem__, found), strict=True))
            return new.difference(found)

        new = unknown(set().union(*lists))
        # Marks behind a letter or digit are cut off too, so that most such words are known ones.
        ended = {w: b for w in new if w[-1:] in _STOPS and (b := w.rstrip(_STOPS))[-1:].isalnum() and "<|" not in w}
        bases = list(unknown(new.difference(ended).union(ended.values())))
        self._learn(bases)
        runs = {w[len(b) :] for w, b in ended.items()}.difference(self.stops)
        self.stops.update(zip(runs, self._encode(list(runs)), strict=True))
        known.update((w, known[b] + self.stops[w[len(b) :]]) for w, b in ended.items())
        if len(self.stops) > _CACHE_STOPS:
            self.stops.clear()
        out = []
        for text, words, o in zip(texts, lists, odd, strict=True):
            raw = b"".join(self._encode(_CUTS.split(text))) if o else b"".join(map(known.__getitem__, words))[self.skip :]
            out.append(np.frombuffer(raw, np.uint32))
        for w in [w for w in new.union(bases) if len(w) > _CACHE_CHARS]:
            del known[w]
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit ranks."""
    ranks = ranks.astype("<u4", copy=False)
    sizes = (ranks > 0xFF).astype(np.uint8)
    if wide := bool(len(ranks)) and int(ranks.max()) > 0xFFFF:
        sizes += ranks > 0xFFFF
        sizes += ranks > 0xFFFFFF
    codes = np.zeros((len(ranks) + 3) // 4 * 4, np.uint8)
    codes[: len(ranks)] = sizes
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    if wide:
        data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= sizes[:, None]]
    else:  # the upper byte of two is kept where it is set
        data = ranks.astype("<u2").view(np.uint8)
        kept = np.ones(len(data), bool)
        kept[1::2] = sizes
        data = data[kept]
    return control.tobytes(), data.tobytes()


_SIZES = np.stack([(np.arange(256) >> s & 3) + 1 for s in (0, 2, 4, 6)], axis=1).astype(np.uint8)


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks of a block."""
    sizes = _SIZES[np.frombuffer(control, np.uint8)].ravel()[:n]
    starts = np.cumsum(sizes, dtype=np.int64)
    starts -= sizes
    raw = np.frombuffer(data, np.uint8)
    out = raw[starts].astype(np.uint32)
    for k in range(1, int(sizes.max(initial=0))):
        own = np.flatnonzero(sizes > k)
        out[own] |= raw[starts[own] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _squeezed(ids: np.ndarray, squeeze: zstandard.ZstdCompressor) -> bytes:
    """Ids by byte planes, compressed: lowest bytes first, then the next ones as far as any is set."""
    wide = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    planes = 4 - int(np.argmax(wide[:, ::-1].any(axis=0))) if len(ids) and wide.any() else 1
    return bytes([planes]) + squeeze.compress(np.ascontiguousarray(wide[:, :planes].T).tobytes())


def _expanded(blob: bytes, n: int, expand: zstandard.ZstdDecompressor) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    out[:, : blob[0]] = np.frombuffer(expand.decompress(blob[1:]), np.uint8).reshape(blob[0], n).T
    return out.view("<u4").ravel()


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, n, blob) of every document, its end id included, and for each task a row with n = -1 that counts its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, squeeze = encoder(tokenizer), zstandard.ZstdCompressor(level=1)
        total = np.zeros(max(len(enc.blank_first), end_id + 1), np.int64)
        for part, texts in common.text_slices(batches, rows=_ROWS):
            made = [np.append(x, np.uint32(end_id)) for x in enc.encode(texts)]
            total += np.bincount(np.concatenate(made), minlength=len(total))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in made], pa.int32()), pa.array([_squeezed(x, squeeze) for x in made], pa.binary())], names=["doc_id", "n", "blob"])
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([-1], pa.int32()), pa.array([squeeze.compress(total.astype("<i8").tobytes())], pa.binary())], names=["doc_id", "n", "blob"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n int, blob binary")


def ranks(tokens: DataFrame, tokenizer: str, end_id: int = END_ID) -> np.ndarray:
    """All ids of the vocabulary, commonest first by their count over all documents; ties by id."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, expand = np.zeros(0, np.int64), zstandard.ZstdDecompressor()
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                found = np.frombuffer(expand.decompress(blob), "<i8")
                total = found.copy() if not len(total) else total + found
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])

    found = tokens.where("n = -1").select("blob").mapInArrow(counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").toPandas()
    used = found["id"].to_numpy(np.int64)
    from tokenizers import Tokenizer

    size = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    return np.concatenate([used, np.setdiff1d(np.arange(size), used)])


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, files: int | None = None) -> None:
    """Encode all ``docs`` (doc_id, text) into the store at ``path``; ``end_id`` closes each document.

    A null text is empty and has the end id alone. Rows of one doc_id follow each other by their ids' number and
    bytes, null doc_ids come first. The texts are tokenized once; what is counted and shuffled are compressed ids.
    """
    spark = docs.sparkSession
    tokens = common.written(spark, tokenized(docs, tokenizer, end_id), "token-ids")
    order = ranks(tokens, tokenizer, end_id)
    rank_of = np.empty(len(order), np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(order)], "rank int, id int").coalesce(1).write.parquet(f"{path}/ranks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand, file, block, at = zstandard.ZstdDecompressor(), TaskContext.get().partitionId(), 0, 0
        ids: list = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            control, data = pack(rank_of[np.concatenate(held)])
            row = {"file": file, "block": block, "at": at, "doc_ids": ids, "lengths": [len(x) for x in held], "control": control, "data": data}
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))

        for batch in batches:
            for i, n, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                ids.append(i)
                held.append(_expanded(blob, n, expand))
                size += n
                if size >= BLOCK_TOKENS:
                    yield flush()
                    block, at, ids, held, size = block + 1, at + size, [], [], 0
        if held:
            yield flush()

    rows = tokens.where("n >= 0").repartitionByRange(files or common.partitions(spark), F.col("doc_id").asc_nulls_first())
    rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n", "blob").mapInArrow(run, _BLOCKS).write.parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the store, decoded from its files.

    ``start`` counts the ids of all documents before; ids_crc32 is the crc32 of the ids as little-endian unsigned
    32-bit integers. The totals of the files, one number each, pass through the driver.
    """
    table = spark.read.parquet(f"{path}/ranks").orderBy("rank").toPandas()["id"].to_numpy(np.uint32)
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    tokens = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    totals = blocks.groupBy("file").agg(F.sum(tokens).alias("n")).orderBy("file").toPandas()
    base = dict(zip(totals["file"].tolist(), (totals["n"].cumsum() - totals["n"]).tolist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"], np.int64)
                found = table[unpack(row["control"], row["data"], int(lengths.sum()))].astype("<u4")
                ends = np.cumsum(lengths)
                docs = [found[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(base[row["file"]] + row["at"] + ends - lengths), pa.array(lengths), pa.array([zlib.crc32(x.tobytes()) for x in docs], pa.int64())]
                if ids:
                    columns.append(pa.array([x.astype(np.int32) for x in docs], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)


def stored(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all ``docs``, written to a store in the shared folder and read back."""
    spark = docs.sparkSession
    path = common.scratch_path(spark, "tokens")
    write(docs, path, tokenizer, end_id)
    return read(spark, path, ids=False)
