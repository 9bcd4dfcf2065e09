import corpus_pipeline
import pytest
from conftest import SF

from packrow.llm import common


def test_stages(spark, tmp_path):
    docs = common.table(spark, SF, "documents")
    before = {r.doc_id for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert k == 4 or tuple(docs.columns) == corpus_pipeline.COLUMNS
        now = [r.doc_id for r in docs.collect()]
        assert set(now) <= before and (k >= 3 or len(now) == len(set(now)))
        before = set(now)
    rows = docs.collect()
    assert rows and all(r.round_trip for r in rows)


@pytest.mark.parametrize("k", range(5))
def test_stages_of_nothing(spark, k):
    docs = common.table(spark, SF, "documents").limit(0)
    assert corpus_pipeline.STAGES[k][1](spark, docs, SF).count() == 0


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} == {x.split("_")[0] for x in names if x.startswith("op")}
