import pytest

import corpus_pipeline

from .conftest import DATA

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="benchmark tables are not here")


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(DATA)).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.columns == docs.columns and after.join(docs, after.columns, "left_anti").isEmpty()
        docs = after
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] >= 0.6 * seen[0]
    texts = [r.text for r in docs.select("text").collect()]
    assert len(texts) == len(set(texts))
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(DATA)).collect()} == ids
