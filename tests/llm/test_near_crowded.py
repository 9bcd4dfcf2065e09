"""Texts that only share a passage which many others have too are told apart without their sets of shingles."""

import numpy as np
import pytest
from test_similar import slow_survivors

from packrow.llm import similar

SCHEMA = "doc_id long, text string"


def with_passage(seed, sizes, passages=(60,)):
    """For each size a text of its own words between the passages, and a changed copy of every second one."""
    rng = np.random.default_rng(seed)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 1_000_000, n)]
    common, out = [word(n) for n in passages], []
    for k, size in enumerate(sizes):
        text = [*word(size // 2), *common[k % len(common)], *word(size - size // 2)]
        out.append(" ".join(text))
        if k % 2:
            for at in rng.integers(0, len(text), 1 + len(text) // 60):
                text[at] = word(1)[0]
            out.append(" ".join(text))
    return dict(enumerate(out, 1))


def test_a_shared_passage_compares_no_sets(spark, monkeypatch):
    compared, plain = [], similar._similar
    monkeypatch.setattr(similar, "_similar", lambda docs, prints, pairs, *a: compared.append(pairs.count()) or plain(docs, prints, pairs, *a))
    texts = {d: t for d, t in with_passage(1, [1500] * 16).items() if d % 3 != 0}
    texts = dict(list(texts.items())[::2])
    docs = spark.createDataFrame(list(texts.items()), SCHEMA)
    assert slow_survivors(texts) == set(texts) and {r.doc_id for r in similar.keep_one(docs, dense=2).collect()} == set(texts)
    assert sum(compared) == 0


@pytest.mark.parametrize("dense", [1, 2, 3, 6])
def test_dense_and_other_keys_together_reach_all_pairs(spark, dense):
    texts = with_passage(2, [20, 40, 60, 90, 130, 200, 280, 400, 15, 25, 35, 50, 70, 110, 160, 240] * 2, (60, 12, 200))
    docs = spark.createDataFrame(list(texts.items()), SCHEMA)
    expected = slow_survivors(texts)
    assert len(expected) < len(texts) - 10
    assert {r.doc_id for r in similar.keep_one(docs, dense=dense).collect()} == expected
