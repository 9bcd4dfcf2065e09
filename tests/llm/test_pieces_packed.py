"""Words and paths that travel to a block's partition."""

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from packrow.llm import common, pieces


@pytest.mark.parametrize("words", [["a"], ["\n", "abc", "x" * 61, "\u2581" + "\U0001f600" * 60, "\u2581\0"], []])
def test_packed_words_come_back(words):
    words = sorted(words, key=str.encode)
    paths = [(1 << 62) - 1 - k for k in range(len(words))]
    data = pieces.packed_words(pa.array([w.encode() for w in words], pa.binary()), np.array(paths, np.int64))
    assert pieces.unpacked_words(len(words), data) == (words, paths)


def test_words_of_a_block_travel_in_few_rows(spark):
    import public_tokenizers

    docs = common.table(spark, SF, "documents").limit(50)
    rows = pieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"), 2)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 4
    assert rows.where(~F.col("round_trip")).count() == 0
