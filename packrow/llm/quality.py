"""Quality classifier: supervised subword embeddings.

Every word has hashed features: itself, its character n-grams and a mark where it repeats the word
before it. Each feature has a learned vector; a document is the mean of the vectors of all its
features, and a softmax over two outputs gives its score. Training is stochastic gradient
descent in numpy over a bounded sample of the labelled documents. As averaging and the output layer
are linear, scoring needs one number for each feature, and a cache of words keeps it cheap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packrow.llm import common, subwords

BUCKETS, DIM, THRESHOLD, FOLDS = 1 << 15, 16, 0.3, 5
#: Labelled documents that train at most, and distinct features of one of them that count at most in training.
SAMPLE = 6000
EPOCHS, RATE, SEED = 12, 0.5, 7
_CACHE_WORDS = 300_000
_REPEAT = b"\x00same"


def _tokens(text: str | None) -> list[bytes]:
    """Words of the text; one that repeats its predecessor becomes a mark of its own."""
    words = (text or "").encode().split()
    return [_REPEAT if a == b else a for a, b in zip(words, [b"", *words], strict=False)]


def _bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of a document and their shares."""
    tokens, counts = np.unique(np.array(_tokens(text), dtype=object), return_counts=True) if text and text.split() else (np.zeros(0, object), np.zeros(0, np.int64))
    if not len(tokens):
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    who, what = subwords.features(list(tokens), BUCKETS)
    total = np.bincount(what, weights=counts[who], minlength=0)
    ids = np.flatnonzero(total)
    return ids.astype(np.int32), (total[ids] / total.sum()).astype(np.float32)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """(margin of each feature, bias): embeddings and output layer learned by SGD, then multiplied out.

    Classes weigh alike, so a rare one is learned too. Without labels, or with one class only, the
    margin is zero and the bias says how likely that class is.
    """
    share = float(labels.mean()) if len(labels) else 0.5
    if len(labels) == 0 or share in (0.0, 1.0):
        return np.zeros(BUCKETS), float(np.log((share + 0.01) / (1.01 - share)))
    rng = np.random.default_rng(SEED)
    vectors = rng.normal(0, 0.5 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (2, DIM)).astype(np.float32), np.zeros(2, np.float32)
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    used = [i for i, (ids, _) in enumerate(bags) if len(ids)]
    for epoch in range(epochs):
        rate = np.float32(RATE * (1 - epoch / epochs) + 0.02)
        for i in rng.permutation(used):
            ids, shares = bags[i][0], bags[i][1].astype(np.float32)
            doc = shares @ vectors[ids]
            z = out @ doc + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            step = rate * min(weight[i], 8.0) * p
            back = step @ out
            out -= np.outer(step, doc)
            bias -= 0.1 * step
            # Each feature moves by its share, scaled so that a document moves as far as its mean.
            vectors[ids] -= np.outer(shares * min(len(ids), 400), back) * np.float32(0.5)
    margin = vectors @ (out[1] - out[0])
    return margin.astype(np.float64), float(bias[1] - bias[0])


class Scorer:
    """Scores texts with a trained model; words already seen come from a bounded cache."""

    def __init__(self, margin: np.ndarray, bias: float):
        self.margin, self.bias, self.known = margin, bias, {}

    def scores(self, texts: list[str]) -> np.ndarray:
        lists = [_tokens(x) for x in texts]
        known = self.known
        if len(known) > _CACHE_WORDS:
            known.clear()
        if new := list({w for ws in lists for w in ws if w not in known}):
            who, what = subwords.features(new, len(self.margin))
            sums, counts = np.bincount(who, weights=self.margin[what], minlength=len(new)), np.bincount(who, minlength=len(new))
            known.update(zip(new, zip(sums.tolist(), counts.tolist(), strict=True), strict=True))
        out = np.empty(len(texts))
        for i, words in enumerate(lists):
            found = [known[w] for w in words]
            n = sum(x[1] for x in found)
            z = self.bias + (sum(x[0] for x in found) / n if n else 0.0)
            out[i] = 1 / (1 + np.exp(-max(-50.0, min(50.0, z))))
        return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """A model from the labelled documents whose crc32 of the id, modulo 5, isn't 0.

    At most ``sample`` of them train it, those with the smallest hashes of their ids; their whole texts
    become bags of features on the executors, and only those reach the driver. Labels other than 0 and
    1 and null ids are left out; a document with several labels counts once for each.
    """
    marks = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", "quality")
    marks = marks.where(common.crc_mod(F.col("doc_id"), FOLDS) != 0).withColumn("_h", F.xxhash64(F.lit(SEED), "doc_id"))
    chosen = marks.orderBy("_h", "doc_id", "quality").limit(sample).select("doc_id", "quality")
    pairs = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in common.text_slices(batches):
            made = [_bag(x) for x in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.int32()), pa.array([x.astype(np.uint16).tobytes() for x, _ in made], pa.binary()), pa.array([x.astype(np.float16).tobytes() for _, x in made], pa.binary())], names=["doc_id", "quality", "ids", "shares"])

    found = pairs.mapInArrow(bags, "doc_id long, quality int, ids binary, shares binary").toArrow().combine_chunks()
    order = np.lexsort((found["quality"].to_numpy(), found["doc_id"].to_numpy()))
    ids, shares = _views(found["ids"], np.uint16), _views(found["shares"], np.float16)
    return train([(ids[i], shares[i]) for i in order.tolist()], found["quality"].to_numpy().astype(np.int64)[order])


def _views(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    """The values of a binary column as arrays over its one buffer, so that nothing is copied."""
    if not len(column):
        return []
    (chunk,) = column.chunks
    ends = np.frombuffer(chunk.buffers()[1], np.int32, len(chunk) + 1, 4 * chunk.offset) // np.dtype(kind).itemsize
    flat = np.frombuffer(chunk.buffers()[2], kind, ends[-1]) if ends[-1] else np.zeros(0, kind)
    return [flat[x:y] for x, y in zip(ends.tolist(), ends[1:].tolist(), strict=False)]


def score(docs: DataFrame, model: tuple[np.ndarray, float], out: str = "score") -> DataFrame:
    """``docs`` with its score in [0, 1], higher where quality 1 is likelier.

    Whole texts are scored; null and empty ones get the score of the bias alone. Only the text is read.
    """
    margin, bias = model[0].astype(np.float32), model[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(margin.astype(np.float64), bias)
        for part, texts in common.text_slices(batches):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scorer.scores(texts), pa.float64())], names=[*part.schema.names, out])

    return docs.mapInArrow(run, docs.withColumn(out, F.lit(0.0)).schema)


def classified(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; repeated rows score alike."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", (common.crc_mod(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with their own columns, whatever their names."""
    (name,) = common.fresh(docs, "_quality")
    return score(docs, fit(docs, labels), name).where(F.col(name) >= threshold).select(*docs.columns)
