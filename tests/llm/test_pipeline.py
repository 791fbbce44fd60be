"""The pipeline against its stages' rules, recomputed by hand, and the registration of queries."""

import __spark_entry__
import corpus_pipeline
from folioflow.llm import quality, queries, toxicity
from folioflow.shipping import ship

from test_operators import check_packing, components_by_hand

SMALL = "/root/testdata/sf0.001"


def test_stages_follow_one_another(spark, tmp_path):
    ship(spark)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        path = f"file://{tmp_path}/{len(seen)}"
        stage(spark, docs, SMALL).write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = (before, docs)
        assert docs.columns == columns and docs.count() <= before.count()
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, after = seen["toxicity"]
    scores = toxicity.score(before, toxicity.fit(before, spark.read.parquet(f"{SMALL}/labels.parquet")))
    assert ids(after) == ids(scores.where("score < 0.3"))
    before, after = seen["quality"]
    assert ids(after) == ids(quality.rate(before).where("kept"))
    before, after = seen["near duplicates"]
    parts = components_by_hand([(r.doc_id, r.text) for r in before.collect()], 5)
    assert ids(after) == {d for d, (_, c) in parts.items() if c == d}
    check_packing(docs, corpus_pipeline.STAGES[-1][1](spark, docs, SMALL))


def test_registered():
    names = set(__spark_entry__.queries())
    assert {f"op{n}_" for n in range(1, 11)} == {x.split("_")[0] + "_" for x in queries.QUERIES} and set(queries.QUERIES) | {"pipeline"} <= names
    assert set(__spark_entry__.oracle_sql()) <= names
