"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and U+0009 to U+000D.
WORD_RE = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which the whole cluster shares.

    One of our own is made only where that setting is missing and Spark runs on one machine, as in tests.
    """
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        spark.sparkContext.setCheckpointDir(where or tempfile.mkdtemp(prefix="spanloom-"))
    return jsc.getCheckpointDir().get()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through files in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of an Arrow batch. Spark bounds batches by rows alone, and its 10,000 are too many for long texts.
BATCH_ROWS = 1000
#: Rows that are worked on at once, so that Python's objects stay small beside the batch.
ROWS = 256


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's batch size, unless somebody has chosen one."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def map_batches(df: DataFrame, rows: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """``mapInArrow`` with one function from a part of a record batch to named columns."""
    names = [f.split()[0] for f in schema.split(", ")]  # a comma inside a type has no space behind it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = rows(batch)
            yield pa.RecordBatch.from_arrays([out[n] for n in names], names=names)

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def crc32_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the decimal id modulo ``n``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch, null as the empty string."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]
