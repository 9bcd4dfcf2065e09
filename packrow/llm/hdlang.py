"""Language identification with hyperdimensional profiles.

Every letter has a random vector of plus and minus ones, a function of its code point alone. An
n-gram of three letters is the product of its letters' vectors, each rotated by its place. A language's
prototype is the sum over all n-grams of its training documents, and a document belongs to the
language whose prototype has the largest cosine with its own sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packrow.llm import common

DIM, GRAM, SEED, FOLDS, HELD = 1024, 3, 11, 4, 2
#: Tasks whose sums one task adds; sums are whole multiples of 1 / _ONE, so that their order changes nothing.
FAN_IN, _ONE = 64, 1 << 24
UNKNOWN = "und"
#: Vectors of n-grams that a worker keeps, one byte for each dimension.
_CACHE = 24_000
_SPACE = 0x20


def _is_letter() -> np.ndarray:
    """For each code point, its lower-case letter or 0."""
    table = np.zeros(0x110000, np.int64)
    for code in range(0x110000):
        if (c := chr(code)).isalpha():
            low = c.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


class Space:
    """Letter and n-gram vectors; everything follows from the seed and the code points."""

    def __init__(self) -> None:
        self.fold, self.letters = _is_letter(), {}
        self.at: dict[int, int] = {}
        self.rows = np.empty((_CACHE, DIM), np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            self.letters[code] = np.where(np.random.Philox(key=[SEED, code]).random_raw(DIM) & np.uint64(1), 1, -1).astype(np.int8)
        return self.letters[code]

    def gram(self, key: int) -> np.ndarray:
        a, b, c = key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def vectors(self, keys: np.ndarray) -> np.ndarray:
        """The vectors of the n-grams, one row each; new ones enter the cache while there is room."""
        if len(keys) > _CACHE:
            return np.stack([self.gram(k) for k in keys.tolist()])
        new = [k for k in keys.tolist() if k not in self.at]
        if len(self.at) + len(new) > _CACHE:
            self.at.clear()
            new = keys.tolist()
        for k in new:
            self.rows[len(self.at)] = self.gram(k)
            self.at[k] = len(self.at)
        return self.rows[[self.at[k] for k in keys.tolist()]]

    def grams(self, text: str) -> np.ndarray:
        """The keys of all n-grams of letters; other characters end a word and stand as one blank around it."""
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        low = self.fold[codes]
        if not low.any():
            return np.zeros(0, np.int64)
        low = np.concatenate([[0], low, [0]])
        keep = (low != 0) | (np.concatenate([[1], low[:-1]]) != 0)
        low = np.where(low == 0, _SPACE, low)[keep]
        keys = (low[:-2] << 42) | (low[1:-1] << 21) | low[2:]
        return keys[low[1:-1] != _SPACE]

    def bundle(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the n-grams' vectors, in blocks, so that many different ones need no more memory."""
        total = np.zeros(DIM)
        for i in range(0, len(keys), 4096):
            total += counts[i : i + 4096].astype(np.float32) @ self.vectors(keys[i : i + 4096]).astype(np.float32)
        return total


_SPACES: list[Space] = []


def _space() -> Space:
    """One for each worker process."""
    if not _SPACES:
        _SPACES.append(Space())
    return _SPACES[0]


def prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, unit prototypes) from all documents with a language whose crc32, modulo 4, isn't 2.

    Each task counts n-grams by language and sends one vector for each of them; each document weighs alike.
    """
    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (common.crc_mod(F.col("doc_id"), FOLDS) != HELD)).select("lang", "text")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, counts = _space(), {}
        sums: dict[str, np.ndarray] = {}

        def settle(lang: str) -> None:
            if found := counts.pop(lang, None):
                sums[lang] = sums.get(lang, 0) + space.bundle(np.fromiter(found, np.int64, len(found)), np.fromiter(found.values(), np.float64, len(found)))

        for part, texts in common.text_slices(batches):
            for lang, text in zip(part.column(0).to_pylist(), texts, strict=True):
                keys = space.grams(text)
                if len(keys):
                    own = counts.setdefault(lang, {})
                    ids, n = np.unique(keys, return_counts=True)
                    for k, v in zip(ids.tolist(), (n / len(keys)).tolist(), strict=True):
                        own[k] = own.get(k, 0.0) + v
                    if len(own) > 200_000:
                        settle(lang)
        for lang in list(counts):
            settle(lang)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([np.rint(x * _ONE).astype(np.int64).tobytes() for x in sums.values()], pa.binary())], names=["lang", "v"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, v in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                sums[lang] = sums.get(lang, 0) + np.frombuffer(v, np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["lang", "v"])

    # Sums of sums: each level has a fraction of the tasks of the one before, and a task keeps one vector for each language.
    rows = common.written(docs.sparkSession, train.mapInArrow(partial, "lang string, v binary"), "language-sums")
    while (n := rows.rdd.getNumPartitions()) > FAN_IN:
        rows = common.written(docs.sparkSession, rows.coalesce(-(-n // FAN_IN)).mapInArrow(total, "lang string, v binary"), "language-sums")
    rows = rows.coalesce(1).mapInArrow(total, "lang string, v binary").orderBy("lang").collect()
    found = np.array([np.frombuffer(r.v, np.int64) / _ONE for r in rows]).reshape(len(rows), DIM)
    return [r.lang for r in rows], found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``.

    score is the softmax of the cosines, sharpened, at the predicted language. Texts that are null or
    have no letter, and all texts where nothing could be learned, are ``und`` with score 0. Whole texts
    count; languages with equal cosine go to the first by name.
    """
    names, vectors = prototypes(docs)
    narrow = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = _space()
        for part, texts in common.text_slices(batches):
            langs, scores = [], []
            for text in texts:
                keys = space.grams(text)
                if not len(keys) or not names:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                own = space.bundle(*np.unique(keys, return_counts=True))
                cosines = vectors @ own / max(np.linalg.norm(own), 1e-12)
                sharp = np.exp((cosines - cosines.max()) * 20)
                langs.append(names[int(cosines.argmax())])
                scores.append(float(1 / sharp.sum()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    found = narrow.mapInArrow(run, docs.select("doc_id", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema)
    return found.select("doc_id", (common.crc_mod(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "lang_pred", "score")
