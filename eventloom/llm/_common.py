"""Shared pieces: the shared scratch folder, text rules, Arrow row mapping and bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The six characters that separate words; ``bytes.split()`` and ``bytes.strip()`` use just these.
WHITE = " \t\n\x0b\x0c\r"
#: A word, for the JVM's and DuckDB's regular expressions alike.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a table that may be broadcast; beyond it a join shuffles.
BROADCAST_ROWS = 1_000_000
#: Rows handed to Python at a time, so that a batch of long texts stays small.
BATCH_ROWS = 1_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, or for a local master a folder made here."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    have = getattr(spark, "_eventloom_scratch", None)
    if have is None:
        have = spark._eventloom_scratch = "file://" + tempfile.mkdtemp(prefix="eventloom-")
    return have


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/eventloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete every scratch table of this application; call it once the results are written."""
    delete_path(spark, f"{shared_dir(spark)}/eventloom-{spark.sparkContext.applicationId}")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_rows(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType, rows: int = BATCH_ROWS) -> DataFrame:
    """``mapInArrow`` whose function sees at most ``rows`` rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(b.slice(i, rows) for b in batches for i in range(0, max(1, b.num_rows), rows))

    return df.mapInArrow(run, schema)


def batch(columns: dict[str, list], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most ``most`` rows (counted); else as it is, for a shuffled join.

    Pass a stashed table: counting it then reads file footers only.
    """
    return F.broadcast(df) if df.count() <= most else df


def n_words(col) -> F.Column:
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
