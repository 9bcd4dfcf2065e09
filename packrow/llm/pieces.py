"""SentencePiece encoding and decoding as a relational lattice.

1. Texts are cut into words where no piece can cross, and every different word is kept once.
2. Each word is exploded into its substrings of at most the longest piece's length, these are
   equi-joined with the piece table (broadcast: a vocabulary is bounded), and the edges found are
   grouped by word.
3. A fold over the word's edges with Spark's higher-order ``aggregate`` chooses the path, a long whose bits are
   the places where its pieces begin and end. For a unigram model the fold is Viterbi: the best score to reach each
   place. A BPE model defines another path than the best sum, so there the fold applies its merges to
   the same lattice. Both give what the model's library gives.
4. Every block of documents gets the paths of its own words and puts its documents together. Blocks are ranges
   of doc_id with about ``BLOCK_BYTES`` of text, and each has a partition of its own. Words and paths travel
   sorted and compressed, many of a block in one row.

Characters that no piece has become byte pieces, or the unknown id where the model has none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packrow.llm import common

SPACE = "▁"
#: A path is a long, so words of more characters are cut where no piece crosses; what stays longer is folded in the worker that needs it.
MAX_WORD = 61
#: Text bytes of a block, and words that a task combines at a time.
BLOCK_BYTES, _HELD = 24_000_000, 400_000
_KEY, _ID, _LATE = 1 << 20, 1 << 24, 1 << 20
_MARKS = ".,|!*$%&#?;:"


class Model:
    """The piece table of a model file, with identity normalisation and a blank before the text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        self.unknown = sp.unk_id()
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}
        plain = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.pieces = [(sp.id_to_piece(i), i, float(sp.get_score(i))) for i in plain]
        self.of = {p: (i, s) for p, i, s in self.pieces}
        self.longest = max(len(p) for p, _, _ in self.pieces)
        self.merges = all(s == int(s) for _, _, s in self.pieces)  # BPE scores are ranks
        if bad := [p for p, _, _ in self.pieces if SPACE in p.lstrip(SPACE) or "\n" in p]:
            raise ValueError(f"pieces that cross words aren't supported: {bad[:3]}")
        self.worst = min(s for _, _, s in self.pieces)
        self.inner = {p[i : i + 2] for p, _, _ in self.pieces for i in range(len(p) - 1)}
        # Where a letter or digit stands before one of these marks, no piece crosses.
        marks = "".join(c for c in _MARKS if not any(b[1] == c and b[0].isalnum() for b in self.inner if b[0].isascii()))
        unsafe = "".join(sorted({b[0] for b in self.inner if b[1] in marks and b[0].isalnum()}))
        word, mark, end = f"[^\\W_{re.escape(unsafe)}]", f"[{re.escape(marks)}]", f"(?=[{SPACE}\n]|$)"
        self.cuts = re.compile(f"{SPACE}*{word}++(?={mark}+{end})|{mark}++{end}|{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        by_byte = {i: bytes([b]) for b, i in self.bytes.items()}
        self.raw = [by_byte.get(i) or ("" if sp.is_control(i) else sp.id_to_piece(i).replace(SPACE, " ") if not sp.is_unknown(i) else " ⁇ ").encode() for i in ids]

    def words(self, text: str) -> list[str]:
        """The text cut where no piece crosses; joined they are the text with a blank before it, blanks marked."""
        return self.cut(SPACE + text.replace(" ", SPACE)) if text else []

    def cut(self, marked: str) -> list[str]:
        found = self.cuts.findall(marked)
        return found if max(map(len, found)) <= MAX_WORD else [part for w in found for part in (self._cut(w) if len(w) > MAX_WORD else (w,))]

    @staticmethod
    def tokens(text: str) -> list[str] | None:
        """The text split at its blanks, if each blank alone begins a word: then ``cut`` may be used token by token."""
        return None if "  " in text or SPACE in text or text[:1] in ("", " ") or text[-1] == " " else text.split(" ")

    def _cut(self, word: str) -> list[str]:
        ends = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.inner]
        return [word[a:b] for a, b in zip([0, *ends], [*ends, len(word)], strict=True)]

    def fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown]

    @cached_property
    def packed(self) -> dict[str, bytes]:
        return {p: np.int32(i).tobytes() for p, (i, _) in self.of.items()}

    def ids(self, word: str, path: int) -> bytes:
        """The ids along a path, as 32-bit integers."""
        out, a, left, packed = [], 0, path >> 1, self.packed
        while left:
            k = (left & -left).bit_length()
            piece = word[a : a + k]
            out.append(packed.get(piece) or np.array(self.fallback(piece), np.int32).tobytes())
            a, left = a + k, left >> k
        return b"".join(out)

    def fold(self, word: str) -> bytes:
        """The ids of one word of any length, as the folds in Spark give them."""
        bounds = self._merged(word) if self.merges else self._best(word)
        return b"".join([self.packed.get(word[a:b]) or np.array(self.fallback(word[a:b]), np.int32).tobytes() for a, b in zip(bounds, bounds[1:], strict=False)])

    @cached_property
    def late(self) -> set[str]:
        """The pieces whose parts don't all rank before them, as training leaves them (runs of blanks, say).

        Without those, a merge never makes a better one possible: inside a piece, merges happen as they do in the
        piece alone, so its parts were merged before its turn, and one pass over a word's edges by rank is exact.
        """
        rank, none = {p: -s for p, _, s in self.pieces}, float("inf")
        found = set()
        for p in rank:
            symbols, last = list(p), -none
            while len(symbols) > 1:
                best, at = min((rank.get(symbols[i] + symbols[i + 1], none), i) for i in range(len(symbols) - 1))
                if best == none:
                    break
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
                if len(symbols) == 1 and last >= rank[p]:
                    found.add(p)
                last = max(last, best)
        return found

    def _merged(self, word: str) -> list[int]:
        import heapq

        n = len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(a: int) -> None:
            if 0 <= a < n and after[a] < n and (end := after[after[a]]) - a <= self.longest and (hit := self.of.get(word[a:end])):
                heapq.heappush(heap, (-hit[1], a, after[a], end))

        for i in range(n):
            offer(i)
        live = [True] * n
        while heap:
            _, a, mid, end = heapq.heappop(heap)
            if live[a] and after[a] == mid and mid < n and live[mid] and after[mid] == end:
                live[mid], after[a] = False, end
                if end < n:
                    before[end] = a
                offer(a)
                offer(before[a])
        bounds, i = [0], 0
        while i < n:
            i = after[i]
            bounds.append(i)
        return bounds

    def _best(self, word: str) -> list[int]:
        n = len(word)
        score, start = [0.0] * (n + 1), [0] * (n + 1)
        for e in range(1, n + 1):
            options = [(score[s] + hit[1], s) for s in range(max(0, e - self.longest), e) if (hit := self.of.get(word[s:e]))]
            if word[e - 1] not in self.of:
                options.append((score[e - 1] + self.worst - 10, e - 1))
            score[e], start[e] = max(options, key=lambda x: (x[0], -x[1]))
        bounds = [n]
        while bounds[-1]:
            bounds.append(start[bounds[-1]])
        return bounds[::-1]

    def decode(self, ids) -> str:
        """The text of the ids: bytes put together, marks turned into blanks, the first blank dropped."""
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


@cache
def model(path: str) -> Model:
    """One for each process and file."""
    return Model(path)


def edges(words: DataFrame, m: Model) -> DataFrame:
    """(word, lattice, ...) of different words.

    For a BPE model the lattice has the edges of two characters or more as sorted longs: rank, whether late, start, length. For a
    unigram model it is a map from start * KEY + end to id and score. The substrings of a word are exploded, joined
    with the pieces and grouped by word; only those that are pieces get as far as that. With the words partitioned
    by word nothing is shuffled. The empty substring, which is no edge, keeps words without any and carries the
    word's other columns.
    """
    spark = words.sparkSession
    order = {s: k for k, s in enumerate(sorted({s for _, _, s in m.pieces}, reverse=True))}
    least = 2 if m.merges else 1
    rows = [("", -1, 0.0), *((p, order[s] << 32 | _LATE * (p in m.late) if m.merges else order[s] * _ID + i, s) for p, i, s in m.pieces if len(p) >= least)]
    table = spark.createDataFrame(rows, "piece string, value long, score double")
    rest = [c for c in words.columns if c != "word"]
    spans = words.select("word", *rest, F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("s"))
    lengths = F.sequence(F.lit(least), F.least(F.lit(m.longest), F.length("word") - F.col("s")))
    lengths = F.when(F.length("word") - F.col("s") >= least, lengths).otherwise(F.array().cast("array<int>"))
    spans = spans.withColumn("l", F.explode(F.when(F.col("s") == 0, F.concat(F.array(F.lit(0)), lengths)).otherwise(lengths)))
    once = [F.when(F.col("l") == 0, F.col(c)).alias(c) for c in rest]
    found = spans.select("word", "s", "l", *once, F.substring("word", F.col("s") + 1, F.col("l")).alias("piece")).join(F.broadcast(table), "piece")
    if m.merges:
        edge = F.when(F.col("l") > 0, F.col("value") + F.col("s") * 256 + F.col("l"))
        lattice = F.sort_array(F.collect_list(edge))
    else:
        edge = F.struct((F.col("s") * _KEY + F.col("s") + F.col("l")).cast("long").alias("k"), F.struct("value", "score").alias("v"))
        lattice = F.map_from_entries(F.collect_list(edge))
    return found.groupBy("word").agg(lattice.alias("lattice"), *[F.max(c).alias(c) for c in rest])


def _at(lattice: Column, a: Column, b: Column) -> Column:
    return F.element_at(lattice, (a.cast("long") * _KEY + b))


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def merge_fold(word: Column, lattice: Column, search: bool = False) -> Column:
    """The path of a word by BPE merges: always the best piece over two neighbours, the first of equal ones.

    The fold's state is the path so far, at first all places. An edge can be merged if of the places from its start
    to its end the path has these two and one between, which then goes. One pass over the edges by rank does it;
    words with a late piece, or all if asked to, ``search`` for the best edge again after each merge.
    """
    one = F.lit(1).cast("long")

    def start(x: Column) -> Column:
        return F.shiftright(x, 8).bitwiseAND(F.lit(63)).cast("int")

    def between(path: Column, x: Column) -> Column:
        """The place between, counted from the start, as a bit; another number where there isn't just one."""
        full = _shift(F.lit(2).cast("long"), x.bitwiseAND(F.lit(63)).cast("int")) - 1
        return F.call_function("shiftright", path, start(x)).bitwiseAND(full) - F.shiftright(full, 1) - 2

    def merged(path: Column, x: Column) -> Column:
        return _bound(between(path, x), lambda place: F.when((place > 1) & (F.bit_count(place) == 1), path - _shift(place, start(x))).otherwise(path))

    def passed(edges: Column) -> Column:
        return F.aggregate(edges, _shift(one, F.length(word) + 1) - 1, merged)

    def searched(edges: Column) -> Column:
        def best(path: Column, _: Column) -> Column:
            return F.aggregate(F.slice(F.filter(edges, lambda x: _bound(between(path, x), lambda place: (place > 1) & (F.bit_count(place) == 1))), 1, 1), path, merged)

        return F.aggregate(F.sequence(F.lit(1), F.length(word)), _shift(one, F.length(word) + 1) - 1, best)

    if search:
        return _bound(lattice, searched)
    return _bound(lattice, lambda edges: F.when(F.exists(edges, lambda x: x.bitwiseAND(F.lit(_LATE)) != 0), searched(edges)).otherwise(passed(edges)))


def _shift(x: Column, by: Column) -> Column:
    return F.call_function("shiftleft", x, by)


def viterbi_fold(word: Column, lattice: Column, longest: int, unknown: float) -> Column:
    """The best path: for each place the best sum of scores so far and where its last edge starts."""

    def step(path: Column, e: Column) -> Column:
        def reach(s: Column) -> Column:
            hit = _at(lattice, s, e)
            own = F.coalesce(hit["score"], F.when(s == e - 1, F.lit(unknown)))
            return F.struct((F.get(path, s)["score"] + own).alias("score"), (-s).alias("back"))

        options = F.filter(F.transform(F.sequence(F.greatest(F.lit(0), e - longest), e - 1), reach), lambda x: x["score"].isNotNull())
        return F.concat(path, F.array(F.array_max(options)))

    begin = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("back")))
    path = F.aggregate(F.sequence(F.lit(1), F.length(word)), begin, step)
    back = lambda p, at: -F.get(p, at)["back"]
    last = F.struct(_shift(F.lit(1).cast("long"), F.length(word)).alias("path"), F.length(word).alias("at"))
    walk = lambda p: F.aggregate(F.sequence(F.lit(1), F.length(word)), last, lambda st, _: F.when(st["at"] == 0, st).otherwise(F.struct((st["path"].bitwiseOR(_shift(F.lit(1).cast("long"), back(p, st["at"])))).alias("path"), back(p, st["at"]).alias("at"))))["path"]
    return F.element_at(F.transform(F.array(path), walk), 1)


def word_paths(words: DataFrame, path: str) -> DataFrame:
    """(word, path, ...) of different, not empty words of at most MAX_WORD characters."""
    m = model(path)
    word, lattice = F.col("word"), F.col("lattice")
    chosen = merge_fold(word, lattice) if m.merges else _bound(lattice, lambda x: viterbi_fold(word, x, m.longest, m.worst - 10))
    return edges(words, m).select("word", chosen.alias("path"), *[c for c in words.columns if c != "word"])


def packed_words(words: pa.Array, paths: np.ndarray) -> bytes:
    """Sorted words of at most MAX_WORD characters and their paths, compressed: lengths in bytes, paths byte by byte, texts."""
    lengths = pc.binary_length(words).to_numpy().astype(np.uint8)
    planes = paths.astype("<i8").view(np.uint8).reshape(-1, 8).T
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), b"")[0].as_py()
    return zstandard.ZstdCompressor(level=3).compress(lengths.tobytes() + planes.tobytes() + texts)


def unpacked_words(n: int, data: bytes) -> tuple[list[str], list[int]]:
    """The words and paths of :func:`packed_words`."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    ends = np.cumsum(np.frombuffer(raw, np.uint8, n), dtype=np.int32)
    paths = np.frombuffer(raw, np.uint8, 8 * n, n).reshape(8, n).T.copy().view("<i8").ravel()
    offsets = np.concatenate([np.zeros(1, np.int32), ends])
    return pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(raw[9 * n :])).to_pylist(), paths.tolist()


def encoded(docs: DataFrame, path: str, blocks: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256, round_trip) for every row of ``docs``.

    ids are the model's for the whole text; decoding them gives the text back (round_trip) unless it holds the
    mark character itself. Null and empty texts have no ids and decode to the empty text. Repeated rows stay.
    Other columns aren't read. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    narrow = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranges = common.Blocks(narrow, BLOCK_BYTES, blocks)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The different words of each block in a task."""
        m, tokens, words = model(path), {}, {}

        def flush() -> Iterator[pa.RecordBatch]:
            for b in tokens.keys() | words.keys():
                found = words.get(b, set())
                for t in tokens.get(b, ()):
                    if t.isalnum() and len(t) < MAX_WORD:
                        found.add(SPACE + t)
                    else:
                        found.update(m.cut(SPACE + t))
                found = [w for w in found if len(w) <= MAX_WORD]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(np.full(len(found), b, np.int32))], names=["word", "block"])
            tokens.clear()
            words.clear()

        for part, texts in common.text_slices(batches):
            for b, text in zip(ranges.of(part.column(0)).tolist(), texts, strict=True):
                if (split := m.tokens(text)) is None:
                    words.setdefault(b, set()).update(m.words(text))
                else:
                    tokens.setdefault(b, set()).update(split)
            if sum(map(len, tokens.values())) + sum(map(len, words.values())) > _HELD:
                yield from flush()
        yield from flush()

    words = narrow.mapInArrow(pairs, "word string, block int").repartition(common.partitions(spark), "word").groupBy("word").agg(F.collect_set("block").alias("blocks"))
    known = word_paths(words, path).select(F.explode("blocks").alias("block"), "path", F.col("word").cast("binary").alias("word"))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words and paths of a task by block."""
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            rows = rows.take(pc.sort_indices(rows, [("block", "ascending"), ("word", "ascending")])).combine_chunks()
            held.clear()
            blocks_, paths = rows["block"].to_numpy(), rows["path"].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], blocks_[1:] != blocks_[:-1]])).tolist()
            ends = [*starts[1:], len(blocks_)]
            data = [packed_words(rows["word"].slice(a, b - a).combine_chunks(), paths[a:b]) for a, b in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(blocks_[starts], pa.int32()), pa.array(np.zeros(len(starts), np.int32)), pa.array(np.subtract(ends, starts).astype(np.int64)), pa.array(data, pa.binary())], names=["block", "kind", "n", "data"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) > _HELD:
                yield from flush()
        if held:
            yield from flush()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for part, texts in common.text_slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ranges.of(part.column(0))), pa.array(np.ones(part.num_rows, np.int32)), part.column(0).cast(pa.int64()), pa.array([squeeze.compress(x.encode()) for x in texts], pa.binary())], names=["block", "kind", "n", "data"])

    known = known.mapInArrow(gathered, "block int, kind int, n long, data binary")
    rows = known.union(narrow.mapInArrow(packed, "block int, kind int, n long, data binary")).repartition(ranges.n, "block").sortWithinPartitions("block", "kind")

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        m, expand, block = model(path), zstandard.ZstdDecompressor(), None
        begun: dict[str, bytes] = {}  # ids of what begins with a blank, which is left out
        inside: dict[str, bytes] = {}

        def known_ids(w: str) -> bytes:
            return m.fold(w) if len(w) > MAX_WORD else begun[w[1:]] if w[0] == SPACE else inside[w]

        def encode(text: str) -> np.ndarray:
            if (split := m.tokens(text)) is None:
                return np.frombuffer(b"".join(map(known_ids, m.words(text))), np.int32)
            for t in set(split).difference(begun):
                begun[t] = b"".join(map(known_ids, m.cut(SPACE + t)))
            return np.frombuffer(b"".join(map(begun.__getitem__, split)), np.int32)

        for batch in batches:
            kinds, blocks_ = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            ends = np.flatnonzero(np.concatenate([[True], (kinds[1:] != kinds[:-1]) | (blocks_[1:] != blocks_[:-1])]))
            for start, end in zip(ends.tolist(), [*ends[1:].tolist(), len(kinds)], strict=True):
                part = batch.slice(start, end - start)
                if blocks_[start] != block:
                    block, begun, inside = blocks_[start], {}, {}
                if kinds[start] == 0:
                    for n, data in zip(part.column(2).to_pylist(), part.column(3), strict=True):
                        for w, p in zip(*unpacked_words(n, data.as_py()), strict=True):
                            if w[0] == SPACE:
                                begun[w[1:]] = m.ids(w, p)
                            else:
                                inside[w] = m.ids(w, p)
                    continue
                for i in range(0, part.num_rows, 64):
                    few = part.slice(i, 64)
                    texts = [expand.decompress(x).decode() if x else "" for x in few.column(3).to_pylist()]
                    made = [encode(x) for x in texts]
                    back = [m.decode(x.tolist()) for x in made]
                    sizes = np.array([len(x) for x in made])
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate([*made, np.zeros(0, np.int32)])))
                    yield pa.RecordBatch.from_arrays([few.column(2), pa.array(sizes.astype(np.int64)), lists, pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back]), pa.array([a == b for a, b in zip(back, texts, strict=True)])], names=["doc_id", "n_tokens", "ids", "decoded_sha256", "round_trip"])

    return rows.mapInArrow(put_together, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string, round_trip boolean")


def decoded(spark: SparkSession, ids: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """``ids`` with ``text`` decoded from its column of piece ids; null gives null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(column)).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if x is None else m.decode(x) for x in lists], pa.string())], names=[*batch.schema.names, "text"])

    return ids.mapInArrow(run, ids.withColumn("text", F.lit("").cast("string")).schema)
