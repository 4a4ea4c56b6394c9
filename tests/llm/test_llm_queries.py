import pytest
from compare import duck, same

from spanloom import llm


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    same(llm.queries()[name](spark, sf_dir), duck(sf_dir), llm.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_empty_tables(spark, empty, name):
    assert llm.queries()[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", [n for n in sorted(llm.queries()) if n.split("_")[0] in ("op2", "op3", "op6", "op7", "op8", "op10")])
def test_odd_rows_give_a_row_each(spark, odd, name):
    from oddrows import ODD

    rows = llm.queries()[name](spark, odd).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ODD)
    assert len({r for r in rows if r.doc_id == 5}) == 1 or name.startswith("op2")


def test_each_operator_has_a_query():
    assert {n.split("_")[0] for n in llm.queries()} == {f"op{i}" for i in range(1, 11)}


#: Names that operators use inside, or return.
CLASHES = "fp node root a b key comp h n up k size place bucket off block slot rank words taken target lang_pred score bits held_out predicted joined base detections found starts packed stream suffixes v dim part x ids media ids_sha256 n_tokens decoded y text_hash error doc vec".split()


def test_other_columns_of_any_name(spark, sf_dir, tmp_path):
    """With further columns in every table the results are the same."""
    from pyspark.sql import functions as F

    for name in ("documents", "embeddings", "pages", "labels"):
        t = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        t.withColumns({c: F.lit("other") for c in CLASHES if c not in t.columns}).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name, query in llm.queries().items():
        a, b = (sorted(map(str, query(spark, d).collect())) for d in (sf_dir, str(tmp_path)))
        assert a == b, name


def test_pipeline_passes_other_columns_on(spark, sf_dir, tmp_path):
    from pyspark.sql import functions as F

    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({c: F.lit("other") for c in CLASHES})
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        assert after.columns == docs.columns and after.select("fp").distinct().collect() == [("other",)]
        docs = after


def test_pipeline_of_odd_and_empty_tables(spark, odd, empty, table):
    import corpus_pipeline
    from oddrows import DOCUMENTS, ODD

    assert corpus_pipeline.run(spark, empty).count() == 0
    folder = table("documents", ODD, DOCUMENTS)
    assert corpus_pipeline.run(spark, folder).count() >= 0
