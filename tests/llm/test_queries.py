"""The registered queries and the pipeline on the smallest tables."""

from __future__ import annotations

import pytest

from tessera.llm import queries as Q
from tests.compare import connect, differences


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    assert not differences(Q.queries()[name](spark, sf_dir), connect(sf_dir), Q.oracle_sql()[name])


def test_pipeline_stages_take_effect(spark, sf_dir):
    import corpus_pipeline as P

    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs, counts = table, []
    for name, stage in P.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), table.schema)
        assert docs.columns == table.columns, name
        counts.append(docs.count())
    assert table.count() > counts[0] > counts[1] == counts[2]
    last = P.STAGES[-1][1](spark, docs, sf_dir)
    assert last.columns == ["doc_id", "lang", "source", "n_tokens", "ids"] and last.count() == counts[3]
    assert P.run(spark, sf_dir).count() == counts[3]
