"""What the plans of operators are made of."""

import re

import pytest

from spanloom import llm


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op2_mixing", "op9_revisits", "op10_licenses"])
def test_native_operators_run_no_python(spark, sf_dir, name):
    assert not re.search("Python|Pandas|Arrow", plan(llm.queries()[name](spark, sf_dir)))


@pytest.mark.parametrize("name", ["op3_language", "op5_quality", "op6_sentencepiece", "op7_matroska", "op10_licenses"])
def test_row_local_operators_shuffle_nothing(spark, sf_dir, name):
    assert "Exchange" not in plan(llm.queries()[name](spark, sf_dir))


@pytest.mark.parametrize("name", ["op6_sentencepiece", "op7_matroska", "op10_licenses"])
def test_scans_read_the_columns_they_need(spark, sf_dir, name):
    assert re.findall(r"ReadSchema: struct<([^>]*)>", plan(llm.queries()[name](spark, sf_dir))) == ["doc_id:bigint,text:string"]


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_no_cross_joins(spark, sf_dir, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(llm.queries()[name](spark, sf_dir)))
