"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType


#: Rows whose values with_column holds as Python objects at a time.
SLICE = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one of the Parquet tables of a data folder through Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local master (tests) gets a folder of its own where that is unset."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
        if not named and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage of df through the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared checkpoint folder: like ``checkpointed``, but smaller and read by column."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_column(df: DataFrame, source: str, name: str, kind: DataType, make: Callable[[list], object]) -> DataFrame:
    """``df`` with a column ``name`` (replaced if there is one) made from lists of the values of ``source``, in Arrow batches."""
    names = df.columns
    at, kept = names.index(source), [i for i, n in enumerate(names) if n != name]
    fields = df.schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                made = pa.array(make(batch.column(at).to_pylist()), to_arrow_type(kind))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), made], names=[*(names[i] for i in kept), name])

    return df.mapInArrow(run, StructType([*(fields[i] for i in kept), StructField(name, kind)]))
