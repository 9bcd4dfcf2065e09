"""The near-duplicate stage finds its classes by SimHash and pigeonring first; the join of sets adds what they leave apart."""

import numpy as np
import pytest

from packrow.llm import graph, simhash, similar


def longer_copies():
    rng = np.random.default_rng(11)
    base = [f"w{x}" for x in rng.integers(0, 100_000, 400)]
    texts = [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in range(5, 395, 30)]
    return [*texts, texts[0].upper(), *(" ".join(f"w{x}" for x in rng.integers(0, 100_000, 300)) for _ in range(20))]


def test_ring_pairs_connect_what_op1_links(spark):
    texts = longer_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = similar.with_keys(docs).cache()
    rows = {r.doc_id: r for r in prints.collect()}
    assert all(r.simhash & (1 << 64) - 1 == simhash.fingerprint(texts[d], similar.WORDS) for d, r in rows.items())
    near = {(a.fp, b.fp) for a in rows.values() for b in rows.values() if a.fp < b.fp and ((a.simhash ^ b.simhash) & (1 << 64) - 1).bit_count() <= 2}
    assert near
    slow = graph.components(spark.createDataFrame(list(near), "a long, b long")).collect()
    assert set(graph.components(similar.ring_pairs(prints)).collect()) == set(slow)


def test_classes_begin_with_the_ring(spark, monkeypatch):
    asked, plain = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a, **k: asked.append(1) or plain(*a, **k))
    docs = spark.createDataFrame(list(enumerate(longer_copies())), "doc_id long, text string")
    assert similar.keep_one(docs).count() == 21 and asked


@pytest.mark.parametrize("edges", [[], [(3, 1), (4, 3), (9, 8)], [(5, 5)], [(k, k + 1) for k in range(200)], [(-7, 1 << 62), (2, -7)]])
def test_few_components(spark, edges):
    rows = spark.createDataFrame(edges, "x long, y long")
    assert sorted(graph.few_components(rows).collect()) == sorted(graph.components(rows).collect())
