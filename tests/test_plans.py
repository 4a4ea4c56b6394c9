"""What the plans of the engine are made of."""

import re

from pyspark.sql import functions as F

from spanloom.plans.engine import Engine


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_analysis_is_one_narrow_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    p = plan(Engine(["legal", "therapy", "finance"]).analyze(docs).where(F.col("score") > 50).select("doc_id", "score"))
    assert "Exchange" not in p and len(re.findall("MapInArrow", p)) == 1
    assert re.findall(r"ReadSchema: struct<([^>]*)>", p) == ["doc_id:bigint,text:string"]


def test_filters_on_keys_reach_the_files(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 5").select("doc_id", "text")
    assert "LessThan(doc_id,5)" in plan(Engine(["legal"]).analyze(docs))


def test_documents_shuffle_by_their_key_alone(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    p = plan(Engine(["legal"]).analyze_documents(docs))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|SinglePartition", p)
    assert set(re.findall(r"hashpartitioning\((\w+)#", p)) == {"doc_id"}
