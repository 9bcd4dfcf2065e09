"""The pipeline's near-duplicates against brute force."""

import corpus_pipeline
import numpy as np
import pytest
from conftest import SF

from packrow.llm import similar


def slow_survivors(texts):
    """Smallest ids of the components of pairs whose 5-word shingles have a Jaccard similarity of 0.8."""
    sets = {}
    for d, t in texts.items():
        w = t.lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    head = {d: d for d in texts}

    def find(d):
        while head[d] != d:
            d = head[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                head[y] = x
    return {d for d in ids if find(d) == d}


def copies():
    """Near copies with changed words, around shared passages and on their own."""
    rng = np.random.default_rng(3)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 100_000, n)]
    out, passage = [], word(30)
    for size, n in ((60, 40), (200, 25), (12, 10)):
        base = word(size)
        for _ in range(n):
            text = list(base)
            for at in rng.integers(0, size, rng.integers(0, 1 + size // 30 + 1)):
                text[at] = word(1)[0]
            out.append(" ".join(text))
    out += [" ".join(passage + word(int(k))) for k in rng.integers(1, 60, 40)]
    out += ["One two", "one  TWO", "", " ", "one two three", *[" ".join(word(8)) for _ in range(10)]]
    return dict(enumerate(out, 1))


@pytest.mark.parametrize("dense, pivots", [(128, 32), (2, 1), (2, 4)])
def test_near_copies_equal_brute_force(spark, monkeypatch, dense, pivots):
    monkeypatch.setattr(similar.links, "__defaults__", (*similar.links.__defaults__[:-1], pivots))
    texts = copies()
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in similar.keep_one(docs, dense=dense).collect()} == slow_survivors(texts)


def test_stage_drops_changed_copies(spark):
    texts = copies()
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.near_stage(spark, docs, SF).collect()} == slow_survivors(texts)


def test_sketches_differ_in_no_more_bits_than_sets():
    rng = np.random.default_rng(5)
    for n in (0, 1, 5, 90, 3000):
        base = rng.integers(0, 1 << 63, n).astype(np.uint64)
        for kept in (0, n // 2, n - n // 8, n):
            other = np.unique(np.concatenate([base[:kept], rng.integers(0, 1 << 63, n - kept).astype(np.uint64)]))
            apart = sum(int(x).bit_count() for x in (similar.sketch(np.unique(base)) ^ similar.sketch(other)).view(np.uint64))
            assert apart <= len(set(base.tolist()) ^ set(other.tolist()))
