"""Quality rules from line labels: a linear-chain conditional random field over the lines of a document.

Every line has a few features (length, symbols, capitals, repetition, how it ends, stock phrases). Emission
and transition weights are trained here by gradient ascent on a bounded sample of labelled
documents, whose quality is the weak label of all their lines. Viterbi decoding marks every line as
content or boilerplate, and the share of words in content lines decides whether a document stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packrow.llm import common

MIN_WORDS, MAX_REPEAT_PERCENT, CONTENT_SHARE = 50, 50, 0.5
#: Labelled documents that train at most.
SAMPLE, EPOCHS, RATE, SEED = 3000, 4, 0.1, 5
_SPACE, _SYMBOL, _TAIL, _UPPER, _DIGIT, _MARK = 1, 2, 4, 8, 16, 32
#: What pages repeat around their text, as fixed values of a feature.
STOCK = (b"all rights reserved", b"cookie", b"copyright", b"licensed under", b"log in", b"privacy policy", b"sign up", b"subscribe", b"terms of use")
STOCK_WORDS = 40


def _classes() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[[0x20, *range(9, 14)]] = _SPACE
    out[[ord(c) for c in "#*$%&|<>"]] = _SYMBOL
    out[0x80:0xC0] = _TAIL
    out[ord("A") : ord("Z") + 1] = _UPPER
    out[ord("0") : ord("9") + 1] = _DIGIT
    out[[ord(c) for c in "!?.,;:'\"()[]{}=+/\\^~_`@-"]] = _MARK
    return out


_CLASS = _classes()
_EDGES = (0.02, 0.1, 0.3, 0.6)
_WORD_EDGES = (1, 2, 5, 10, 20, 40)
N_FEATURES = 1 + (len(_WORD_EDGES) + 1) + 4 * (len(_EDGES) + 1) + 5


@dataclass
class Lines:
    """A document's base figures and the features of its lines."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    words: np.ndarray
    features: np.ndarray

    @property
    def failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words


def _steps(values: np.ndarray, edges: tuple) -> np.ndarray:
    """One column for each interval between the edges."""
    return np.eye(len(edges) + 1)[np.searchsorted(edges, values, side="right")]


def _repeats(ids: np.ndarray) -> int:
    """Words in 3-word windows that occur at least twice."""
    if len(ids) < 4:
        return 0
    n = int(ids.max()) + 1
    pair = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1] if n > 2_000_000 else ids[:-1] * n + ids[1:]
    _, at, counts = np.unique(pair[:-1] * n + ids[2:], return_inverse=True, return_counts=True)
    hit = counts[at] > 1
    marked = np.zeros(len(ids), bool)
    for k in range(3):
        marked[k : k + len(hit)] |= hit
    return int(marked.sum())


def _stock(line: bytes, n_words: int) -> float:
    """Stock phrases of a line of any length: 1 if there is one for every STOCK_WORDS words, less in proportion if there are fewer."""
    low = line.lower()
    return min(1.0, STOCK_WORDS * sum(low.count(s) for s in STOCK) / max(n_words, 1))


def read(text: str | None) -> Lines:
    """All figures of one text; a null text is empty and has one empty line."""
    raw = (text or "").encode()
    data = np.frombuffer(raw, np.uint8)
    kind = _CLASS[data]
    space = kind == _SPACE
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])) if len(data) else np.zeros(0, np.int64)
    words = raw.split()
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    lines = raw.split(b"\n")
    ends = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)) + 1)
    begins = ends - np.fromiter(map(len, lines), np.int64, len(lines)) - 1
    seen: set[bytes] = set()
    dup = np.zeros(len(lines))
    for i, line in enumerate(lines):
        if line in seen:
            dup[i] = 1
        else:
            seen.add(line)
    per_line = np.bincount(np.searchsorted(ends, starts, side="right"), minlength=len(lines)) if len(starts) else np.zeros(len(lines), np.int64)
    dup *= per_line > 0

    def count(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag)])
        return (total[np.minimum(ends, len(data))] - total[begins]).astype(np.float64)

    chars = np.maximum(count(~space & (kind != _TAIL)), 1)
    whose = np.searchsorted(ends, starts, side="right")
    again = np.concatenate([[False], (ids[1:] == ids[:-1]) & (whose[1:] == whose[:-1])]) if len(ids) else np.zeros(0, bool)
    repeated = np.bincount(whose, weights=again, minlength=len(lines)) if len(ids) else np.zeros(len(lines))
    tails = [line.rstrip() for line in lines]
    features = np.hstack([
        np.ones((len(lines), 1)),
        _steps(per_line, _WORD_EDGES),
        _steps(count(kind == _SYMBOL) / chars, _EDGES),
        _steps(count(kind == _UPPER) / chars, _EDGES),
        _steps(count((kind == _MARK) | (kind == _DIGIT)) / chars, _EDGES),
        _steps(repeated / np.maximum(per_line, 1), _EDGES),
        np.array([[x[-1:] in (b".", b"!", b"?"), x[-2:] == b"!!", x[-1:] == b"|", d, _stock(x, n)] for x, d, n in zip(tails, dup, per_line.tolist(), strict=True)], float),
    ])
    return Lines(len(words), int((~space & (kind != _TAIL)).sum()), int((kind == _SYMBOL).sum()), int(dup.sum()), _repeats(ids), per_line, features)


def viterbi(emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The likeliest labels for emission scores (lines x labels) and transition scores; ties go to the lower label."""
    n, k = emit.shape
    back, best = np.zeros((n, k), np.int8), emit[0].tolist()
    steps = move.tolist()
    for t in range(1, n):
        row, nxt = emit[t].tolist(), []
        for j in range(k):
            i = max(range(k), key=lambda i: (best[i] + steps[i][j], -i))
            back[t, j] = i
            nxt.append(best[i] + steps[i][j] + row[j])
        best = nxt
    out = np.empty(n, np.int64)
    out[-1] = int(np.argmax(best))
    for t in range(n - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def _expected(emit: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of labels and of label pairs, by forward and backward sums."""
    n, k = emit.shape
    fwd, bwd = np.empty((n, k)), np.zeros((n, k))
    fwd[0] = emit[0]
    for t in range(1, n):
        fwd[t] = np.logaddexp.reduce(fwd[t - 1][:, None] + move, axis=0) + emit[t]
    for t in range(n - 2, -1, -1):
        bwd[t] = np.logaddexp.reduce(move + emit[t + 1] + bwd[t + 1], axis=1)
    z = np.logaddexp.reduce(fwd[-1])
    pairs = np.exp(fwd[:-1, :, None] + move + (emit[1:] + bwd[1:])[:, None, :] - z).sum(axis=0) if n > 1 else np.zeros((k, k))
    return np.exp(fwd + bwd - z), pairs


def train(docs: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """(emission weights, transitions) for labels 0 boilerplate and 1 content.

    Each document's lines carry its label; both classes weigh alike. Without documents of both labels
    nothing can be learned and every line is content.
    """
    weights, move = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
    share = np.mean([y for _, y in docs]) if docs else 0.0
    if share in (0.0, 1.0):
        weights[0, 1] = 1.0
        return weights, move
    rng = np.random.default_rng(SEED)
    for epoch in range(epochs):
        rate = RATE / (1 + epoch)
        for i in rng.permutation(len(docs)):
            x, y = docs[i]
            odds, pairs = _expected(x @ weights, move)
            scale = rate * (0.5 / share if y else 0.5 / (1 - share)) / len(x)
            odds[:, y] -= 1
            weights -= scale * (x.T @ odds) + 1e-5 * weights
            pairs[y, y] -= len(x) - 1
            move -= scale * pairs
    return weights, move


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Weights learned from at most ``sample`` labelled documents, those with the smallest hashes of their ids.

    Whole documents become line features on the executors; only those reach the driver.
    """
    marks = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", "quality", F.xxhash64(F.lit(SEED), "doc_id").alias("_h"))
    chosen = marks.orderBy("_h", "doc_id", "quality").limit(sample).select("doc_id", "quality")
    pairs = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in common.text_slices(batches):
            made = [read(x).features.astype(np.float32).tobytes() for x in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.int32()), pa.array(made, pa.binary())], names=["doc_id", "quality", "x"])

    rows = sorted(pairs.mapInArrow(lines, "doc_id long, quality int, x binary").toArrow().to_pylist(), key=lambda r: (r["doc_id"], r["quality"], r["x"]))
    return train([(np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES).astype(np.float64), r["quality"]) for r in rows])


def judged(docs: DataFrame, labels: DataFrame, share: float = CONTENT_SHARE) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_content_lines) by row.

    A null text is empty and fails the base rules. A document that passes them stays if at least ``share`` of
    its words stand in lines labelled content. Whole texts are read; other columns aren't.
    """
    weights, move = fit(docs, labels)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in common.text_slices(batches):
            rows = []
            for text in texts:
                d = read(text)
                marks = viterbi(d.features @ weights, move)
                kept = not d.failed and float(d.words[marks == 1].sum()) >= share * d.n_words
                rows.append((*(getattr(d, n) for n in names), d.failed, kept, len(marks), int(marks.sum())))
            cols = list(zip(*rows, strict=True))
            arrays = [pa.array(c, pa.int64()) for c in cols[:5]] + [pa.array(c, pa.bool_()) for c in cols[5:7]] + [pa.array(c, pa.int64()) for c in cols[7:]]
            yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["doc_id", *names, "base_failed", "kept", "n_lines", "n_content_lines"])

    schema = docs.select("doc_id", *[F.lit(0).cast("long").alias(n) for n in names], F.lit(True).alias("base_failed"), F.lit(True).alias("kept"), F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_content_lines")).schema
    return docs.select("doc_id", "text").mapInArrow(run, schema)
