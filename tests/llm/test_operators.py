"""Each operator against a brute-force version, an exact round trip or held-out accuracy; nulls, empties, repeats and ties."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from packrow.llm import common, crf, graph, hdlang, iblt, linededup, mixing, pieces, quality, queries, simhash, substrings, tokenstore, windows

WS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, bucket int, _drops string"
LONG = "long text without any stop " * 4000
ROWS = [
    (1, None, None, None), (2, "", "en", "a"), (3, "   \n\t", "en", "a"), (4, "one two", "en", None), (4, "one two", "en", None), (5, "One  TWO", None, "b"), (6, LONG, "en", "b"),
    (7, "äöü ß\n" * 3, "de", "b"), (None, "no id at all here", "en", "b"), (None, None, None, None), (9, "x" * 3000, "en", "c"), (4, "another text under one id", "en", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns whose names clash with working ones."""
    return spark.createDataFrame([(i, t, lang, s, 0, 5, 6, "x") for i, t, lang, s in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, SF, "documents")


@pytest.fixture(scope="module")
def labels(spark):
    return common.table(spark, SF, "labels")


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# 1 --------------------------------------------------------------------------------------------------------------


def slow_print(text):
    words = WS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints):
    """Smallest id reachable over fingerprints within two bits."""
    values = sorted(set(prints.values()))
    head = {v: v for v in values}

    def find(v):
        while head[v] != v:
            v = head[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                head[find(b)] = find(a)
    least = defaultdict(lambda: 1 << 62)
    for d, v in prints.items():
        least[find(v)] = min(least[find(v)], d)
    return {d: least[find(v)] for d, v in prints.items()}


def test_simhash_equals_brute_force(spark, docs):
    found = {r.doc_id: r for r in queries.op1_simhash(spark, SF).collect()}
    prints = {d: slow_print(t) for d, t in texts_of(docs)}
    assert {d: int(r.fingerprint, 16) for d, r in found.items()} == prints
    assert {d: r.component_id for d, r in found.items()} == slow_components(prints)


@pytest.mark.parametrize("dense", [1, 4, 1024])
def test_links_are_complete(spark, dense):
    """A dense cluster, pairwise or through shared points: the same classes as brute force."""
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 1 << 63, 6)]
    values = sorted({b ^ (1 << int(i)) ^ (1 << int(j)) ^ (1 << int(k)) for b in base for i, j, k in rng.integers(0, 64, (40, 3))} | set(base))
    table = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)], "doc_id long, fp long")
    found = {r.fp % (1 << 64): r.component_id for r in simhash.classes(table, dense).collect()}
    wanted = slow_components(dict(enumerate(values)))
    assert {i: found[v] for i, v in enumerate(values)} == wanted


def test_simhash_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ROWS) and simhash.near_duplicates(none).count() == 0
    assert {r.component_id for r in rows if r.fingerprint == "0" * 16} == {1}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sum(r.text == "one two" for r in kept.collect()) == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(5, 5), (200, 150)]
    found = dict(graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {found[i] for i in range(31)} == {0} and {found[i] for i in range(100, 140)} == {100} and found[200] == 150


# 2 --------------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=120), st.sets(st.integers(0, 2**64 - 1), max_size=120), st.sets(st.integers(0, 2**64 - 1), max_size=120))
def test_peeling_recovers_the_difference(a, b, both):
    x, y = (np.array(sorted(s | both), np.uint64) for s in (a, b))
    assert iblt.differences([x, x], [y, x]).tolist() == [len((a | both) ^ (b | both)), 0]
    whole, _, keys, sign = iblt.peel(iblt.sketch([x], 3072), iblt.sketch([y], 3072))
    assert whole[0] and {(int(k), int(s)) for k, s in zip(keys, sign, strict=True)} == {(k, 1) for k in (a | both) - (b | both)} | {(k, -1) for k in (b | both) - (a | both)}
    n, parsed = iblt.parse(iblt.fingerprints([x])[0])
    assert n == len(x) and all((p == q).all() for p, q in zip(parsed, iblt.sketch([x], iblt.CELLS), strict=True))


@pytest.mark.parametrize("buckets", [1, 3, 7])
def test_fingerprints_equal_brute_force(spark, docs, buckets):
    rows = sorted(texts_of(docs), reverse=True)
    found = {r.doc_id: r for r in iblt.compared(docs, buckets).collect()}
    for k, (d, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        made, r = t[: len(t) - len(t) // 2] + after[: len(t) // 2], found[d]
        a, b, c = (set(iblt.digests(x).tolist()) for x in (t, made, after))
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(made.encode()).hexdigest())
        assert r.near_edited == pytest.approx(len(a & b) / len(a | b)) and r.near_next == pytest.approx(len(a & c) / len(a | c))


def test_fingerprints_odd_rows(odd, none):
    rows = iblt.compared(odd, 3).collect()
    assert len(rows) == len(ROWS) and iblt.compared(none).count() == 0
    assert len({r.fingerprint for r in rows if r.n_chars == 0}) == 1 and all(0 <= r.near_next <= 1 for r in rows)


# 3 --------------------------------------------------------------------------------------------------------------

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_pieces_equal_the_library(spark, odd, none):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=PIECES)
    more = spark.createDataFrame([(100, "  a  b "), (101, "a\n\n b\tc"), (102, "日本語😀 x　y"), (103, "=" * 300 + "#-" * 100), (104, "ab\x00c <0x41> </s>")], "doc_id long, text string")
    rows = odd.select("doc_id", "text").union(more)
    found = sorted((r.doc_id is None, r.doc_id or 0, r.ids, r.n_tokens, r.round_trip) for r in pieces.encoded(rows, PIECES, 2).collect())
    assert found == sorted((d is None, d or 0, ids := sp.encode(t or ""), len(ids), True) for d, t in texts_of(rows))
    assert pieces.encoded(none, PIECES).count() == 0
    back = pieces.decoded(spark, pieces.encoded(rows, PIECES, 2), PIECES).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for _, t in texts_of(rows))


def test_viterbi_fold_equals_brute_force(spark):
    """A small unigram table: the fold, the worker's own fold, and all segmentations agree."""
    table = {"a": -1.5, "b": -2.0, "ab": -2.2, "bc": -2.1, "abc": -4.5, "ca": -1.0, "cab": -2.9}
    m = object.__new__(pieces.Model)
    m.pieces, m.bytes, m.unknown, m.merges, m.longest = [(p, i, s) for i, (p, s) in enumerate(table.items())], {}, 99, False, 3
    m.of, m.worst = {p: (i, s) for p, i, s in m.pieces}, -4.5

    def best(w):
        if not w:
            return 0.0, []
        options = [(table[w[:n]] + best(w[n:])[0], [m.of[w[:n]][0], *best(w[n:])[1]]) for n in range(1, 4) if w[:n] in table and len(w) >= n]
        if w[0] not in table:
            options.append((m.worst - 10 + best(w[1:])[0], [99, *best(w[1:])[1]]))
        return max(options)

    words = ["abcab", "cabab", "ccc", "xabx", "a", "bcabcabca"]
    d = pieces.edges(spark.createDataFrame([(w,) for w in words], "word string"), m)
    d = d.select("word", pieces.viterbi_fold(F.col("word"), F.col("lattice"), 3, m.worst - 10).alias("path"))
    ids = lambda raw: np.frombuffer(raw, np.int32).tolist()
    assert {r.word: ids(m.ids(r.word, r.path)) for r in d.collect()} == {w: best(w)[1] for w in words} == {w: ids(m.fold(w)) for w in words}


def test_pieces_equal_the_library_on_all_documents(spark, docs):
    from sentencepiece import SentencePieceProcessor

    texts = dict(texts_of(docs))
    rows = pieces.encoded(docs, PIECES, 3).collect()
    wanted = SentencePieceProcessor(model_file=PIECES).encode([texts[r.doc_id] or "" for r in rows])
    assert len(rows) == len(texts) and [r.ids for r in rows] == wanted and all(r.round_trip for r in rows)


def test_merge_folds_agree(spark):
    """One pass by rank, the search for the best edge after each merge, and the worker's heap."""
    m = pieces.model(PIECES)
    rng = random.Random(5)
    words = sorted({"▁" * rng.randint(0, 1) + "".join(rng.choice("abcehinorst") for _ in range(rng.randint(1, 60))) for _ in range(300)} | {"a", "▁", "é日", "a" * 61, "▁" * 40 + "ab", "▁" * 61})
    d = pieces.edges(spark.createDataFrame([(w,) for w in words], "word string"), m)
    rows = d.select("word", *(pieces.merge_fold(F.col("word"), F.col("lattice"), o).alias(f"p{o:d}") for o in (True, False))).collect()
    assert len(rows) == len(words) and all(m.ids(r.word, r.p1) == m.ids(r.word, r.p0) == m.fold(r.word) for r in rows)


def test_dealt_keys(spark):
    for n in (1, 7, 64):
        keys = common.dealt_keys(n).tolist()
        at = spark.createDataFrame([(int(k),) for k in keys], "k int").repartition(n, "k").select(F.spark_partition_id().alias("p"), "k").collect()
        assert {r.k: r.p for r in at} == {k: i for i, k in enumerate(keys)}


# 4, 5, 7 ----------------------------------------------------------------------------------------------------------


def test_quality_held_out(spark, docs, labels):
    marks = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality.classified(common.table(spark, SF.replace("0.001", "0.01"), "documents"), common.table(spark, SF.replace("0.001", "0.01"), "labels")).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    marks = {r.doc_id: r.quality for r in common.table(spark, SF.replace("0.001", "0.01"), "labels").collect()}
    held = [(marks[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in marks]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_quality_odd_rows(odd, none, labels):
    rows = quality.classified(odd, labels).collect()
    assert len(rows) == len(ROWS) and quality.classified(none, labels.limit(0)).count() == 0
    assert quality.accepted(odd, labels).columns == odd.columns


def test_rules_base_figures(spark, docs, labels):
    for r in crf.judged(docs, labels).collect():
        text = next(t for d, t in texts_of(docs.where(F.col("doc_id") == r.doc_id))) if r.doc_id % 40 == 0 else None
        if text is None:
            continue
        words = WS.findall(text)
        grams = defaultdict(list)
        for i in range(len(words) - 2):
            grams[tuple(words[i : i + 3])].append(i)
        twice = {k for at in grams.values() if len(at) > 1 for i in at for k in (i, i + 1, i + 2)}
        lines = text.split("\n")
        dup = sum(bool(WS.search(x)) and x in lines[:i] for i, x in enumerate(lines))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(twice))
        assert r.base_failed == (len(words) < 50 or 100 * len(twice) > 50 * len(words)) and not (r.base_failed and r.kept)


def test_rules_keep_good_and_drop_bad(spark):
    sf = SF.replace("0.001", "0.01")
    marks = {r.doc_id: r.quality for r in common.table(spark, sf, "labels").collect()}
    rows = [r for r in crf.judged(common.table(spark, sf, "documents"), common.table(spark, sf, "labels")).collect() if r.doc_id in marks and not r.base_failed]
    good, bad = ([r.kept for r in rows if marks[r.doc_id] == q] for q in (1, 0))
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(-3, 3), st.integers(-3, 3)), min_size=1, max_size=7), st.lists(st.integers(-3, 3), min_size=4, max_size=4))
def test_viterbi_equals_brute_force(emit, move):
    from itertools import product

    e, m = np.array(emit, float), np.array(move, float).reshape(2, 2)
    total = lambda y: sum(e[i, k] for i, k in enumerate(y)) + sum(m[a, b] for a, b in zip(y, y[1:], strict=False))
    assert total(crf.viterbi(e, m).tolist()) == max(total(y) for y in product((0, 1), repeat=len(e)))


def test_rules_odd_rows(odd, none, labels):
    rows = crf.judged(odd, labels).collect()
    assert len(rows) == len(ROWS) and all(r.base_failed and r.n_lines == 1 for r in rows if r.n_words == 0 and r.doc_id in (1, 2))
    assert crf.judged(none, labels).count() == 0


def test_language_held_out(spark, docs):
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = queries.op7_language(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in rows if r.held_out]) > 0.95


def test_language_odd_rows(odd, none):
    rows = {(r.doc_id, r.lang_pred) for r in hdlang.identified(odd).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (None, "und")} <= rows
    assert hdlang.identified(none).count() == 0 and {r.lang_pred for r in hdlang.identified(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# 6 --------------------------------------------------------------------------------------------------------------


def slow_lines(rows, least=5):
    key = lambda line: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < least or max(holders[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_lines_equal_brute_force(spark, docs):
    rows = texts_of(docs)
    line = "A line that many of the documents share, word for word. "
    rows += [(1000 + i, f"{line.upper() if i % 2 else line}\nown {i}\n  {line}\n") for i in range(9)] + [(2000, None), (2001, ""), (2002, line + "x" * 50_000)]
    rows += [(3000 + i, "y" * 45 + "  " + end) for i in range(6) for end in ("\u0085", "\u2028", "\u2029")]  # no blanks here, so they stay in the key
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for batches in (1, 4):
        done = linededup.deduplicated(df, batches)
        found = done.select("doc_id", "_n_lines", "_n_dropped", F.sha2(F.col("_kept").cast("binary"), 256)).collect()
        assert sorted(map(tuple, found)) == slow_lines(rows)


def test_lines_keep_clashing_columns(spark):
    rows = [(i, "the same long line in all of the documents here\nown", 1, 2, {"a": 1}) for i in range(7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _drops int, _lines int, m map<string,int>")
    done = linededup.deduplicated(df).collect()
    assert {(r.doc_id, r._kept, r._drops, r._lines, r.m["a"]) for r in done} == {(i, "own" if i < 6 else rows[6][1], 1, 2, 1) for i in range(7)}


def test_stages_keep_clashing_columns(spark, labels):
    df = spark.createDataFrame([(i, f"one two three {i}", "s", 7, 8, 9) for i in range(4)], "doc_id long, text string, source string, _size int, _copy int, _quality int")
    for done in (mixing.mixed(df), quality.accepted(df, labels, 0.0)):
        assert done.columns == df.columns and done.count() and {(r._size, r._copy, r._quality) for r in done.collect()} == {(7, 8, 9)}


def test_lines_compact_and_odd_rows(spark, odd, none):
    runs = linededup.LineRuns(spark, 2, 2)
    for high in range(9, 0, -1):
        runs.add(spark.range(high * 10, high * 10 + 10).select((F.col("id") % 7).alias("k1"), F.lit(0).cast("long").alias("k2"), F.col("id").alias("doc_id")))
    assert sum(map(len, runs.levels)) <= 4
    assert {r.k1: (r.docs, r.top) for r in runs.totals().collect()} == {k: (sum(1 for i in range(10, 100) if i % 7 == k), max(i for i in range(10, 100) if i % 7 == k)) for k in range(7)}
    assert linededup.report(odd).count() == len(ROWS) and linededup.report(none).count() == 0


# 8 --------------------------------------------------------------------------------------------------------------

TOKENS = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=60))
def test_packing_roundtrip(values):
    ranks = np.array(values, np.uint32)
    control, data = tokenstore.pack(ranks)
    assert len(control) == (len(values) + 3) // 4 and tokenstore.unpack(control, data, len(values)).tolist() == values


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab 'st.,!?;:|*$%&#)\n\t1é<|>日 \u3000", max_size=30), max_size=5))
def test_encoder_equals_the_library(texts):
    enc = tokenstore.encoder(TOKENS)
    assert [x.tolist() for x in enc.encode(texts)] == [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_encoder_equals_the_library_on_all_documents(docs):
    enc = tokenstore.Encoder(TOKENS)
    texts = [t or "" for _, t in texts_of(docs)]
    tokenstore._CACHE_WORDS, kept = 2000, tokenstore._CACHE_WORDS  # so that generations change
    try:
        for i in range(0, len(texts), 50):
            assert [x.tolist() for x in enc.encode(texts[i : i + 50])] == [e.ids for e in enc.tokenizer.encode_batch(texts[i : i + 50], add_special_tokens=False)]
    finally:
        tokenstore._CACHE_WORDS = kept


def test_store_roundtrip(spark, odd, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENS)
    start, wanted = 0, []
    rows = sorted(((d is not None, d or 0, len(ids := tok.encode(t or "", add_special_tokens=False).ids), ids) for d, t in texts_of(odd)), key=lambda r: r[:3])
    for some, d, n, ids in rows:
        wanted.append((d if some else None, start, n + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes())))
        start += n + 1
    assert [tuple(r) for r in tokenstore.stored(odd, TOKENS).orderBy("start").collect()] == wanted
    path = common.scratch_path(spark, "test-tokens")
    tokenstore.write(odd, path, TOKENS, files=3)
    assert [r.ids for r in tokenstore.read(spark, path).orderBy("start").collect()] == [[*ids, 2] for _, _, _, ids in rows]
    assert tokenstore.stored(none, TOKENS).count() == 0


# 9 --------------------------------------------------------------------------------------------------------------


def slow_windows(rows):
    first, marks = {}, defaultdict(set)
    split = [(d, WS.findall(t or "")) for d, t in rows]
    for d, words in sorted(split, key=lambda r: r[0]):
        for i in range(len(words) - 19):
            if first.setdefault(tuple(words[i : i + 20]), (d, i)) < (d, i):
                marks[d] |= set(range(i, i + 20))
    return sorted((d, len(w), len(marks[d]), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in marks[d]).encode()).hexdigest()) for d, w in split)


def test_substrings_equal_brute_force(spark, docs):
    rng = np.random.default_rng(3)
    base = [f"w{int(x)}" for x in rng.integers(0, 50, 400)]
    rows = [(d + 500, t) for d, t in texts_of(docs)]
    for i in range(40):
        a, n = rng.integers(0, 350), rng.integers(15, 60)
        rows.append((i, " ".join([*(f"u{i}_{k}" for k in range(5)), *base[a : a + n], *(f"v{i}_{k}" for k in range(5)), *base[a + 3 : a + 40]])))
    rows += [(300, "same " * 100), (301, "same " * 30), (302, None), (303, "a b " * 200), (304, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for batches, blocks in ((1, 1), (2, 3), (3, 5)):
        assert sorted(map(tuple, substrings.deduplicated(df, batches, blocks).collect())) == slow_windows(rows)


def test_substrings_compact_and_odd_rows(spark, odd, none):
    assert substrings.deduplicated(odd).count() == len(ROWS) and substrings.deduplicated(none).count() == 0
    index = substrings.Index(spark, 2)
    for k in range(3):
        index.add(spark.createDataFrame([(7, k, k, k, 1), (k, 1, 0, k, 1)], "h long, a long, block int, doc long, n int"))
    hits = lambda: sorted((r.h, r.block, r.a, r["first"], r.many) for r in index.hits().collect())
    before = hits()
    index.compact()
    assert len(index.runs) == 1 and hits() == before == [(7, k, k, k, True) for k in range(3)]


def test_equal_windows_have_equal_anchors():
    words = [b"x%d" % (i % 37) for i in range(200)]
    grams, wins = windows.hashes(words)
    first, at = windows.anchors(grams, len(wins))
    count = np.diff(np.append(first, len(wins)))
    seen = {}
    for w, a in zip(wins.tolist(), np.repeat(grams[at], count).tolist(), strict=True):
        assert seen.setdefault(w, a) == a
    assert len(seen) == 37


# 10 -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracles(spark, name):
    from conftest import same

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    same(queries.QUERIES[name](spark, SF), con, queries.ORACLE_SQL[name])


def test_mixing_is_near_its_targets(spark, odd, none):
    rows = [(i, "w " * (1 + i % 50), f"s{i % 3}" if i % 10 < 7 else "hot") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(df).collect()
    by = defaultdict(list)
    for r in found:
        assert r.taken in (0, r.size, 2 * r.size)
        by[r.source].append(r)
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= 60 and own[0].target <= 2 * own[0].source_size + 1e-9
    assert sorted(map(tuple, found)) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()))
    assert mixing.mixed(df).count() == sum(r.taken // r.size for r in found)
    assert mixing.mix(odd).count() == len(ROWS) and mixing.mix(none).count() == 0 and mixing.mixed(odd).columns == odd.columns


def test_targets(spark):
    d = spark.createDataFrame([("a", 100), ("b", 100), ("c", 1000), (None, 0)], "source string, source_size long")
    found = {r.source: r.target for r in mixing.targets(d).collect()}
    assert found == {"a": 200.0, "b": 200.0, "c": pytest.approx(1400.0), None: 0.0}
