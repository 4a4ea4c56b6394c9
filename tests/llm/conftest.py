from __future__ import annotations

import pytest
from oddrows import DOCUMENTS, ODD


@pytest.fixture
def table(spark, tmp_path):
    """Writes a table as Parquet; gives the folder, which stands for one of the driver's."""

    def write(name: str, rows: list, schema: str):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write


@pytest.fixture
def odd(table):
    return table("documents", ODD, DOCUMENTS)


@pytest.fixture
def empty(table):
    table("labels", [], "doc_id long, quality int, toxic int")
    table("embeddings", [], "vec_id long, embedding array<float>, label int")
    table("pages", [], "page_id long, url string, html string")
    return table("documents", [], DOCUMENTS)
