"""Small helpers that the corpus operators share."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table that lies in fewer parts than there are cores, dealt anew; any larger one as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Where the setting is absent a local master (tests on one machine) uses a folder of this
    process; a cluster has to name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def joined(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner", *, small: bool = False) -> DataFrame:
    """A join whose way the caller chooses: ``right`` is broadcast if ``small`` (counted), else both sides are sorted and merged.

    Spark's own choice goes by the bytes of stored files; rows that are much alike are a hundred times as large in memory.
    """
    return left.join(F.broadcast(right) if small else right.hint("merge"), on, how)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package once an application, for functions that run there."""
    if spark.sparkContext.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent.parent
        to = tempfile.mkdtemp(prefix="package-")  # the driver serves this file to the executors
        spark.sparkContext.addPyFile(shutil.make_archive(f"{to}/{package.name}", "zip", package.parent, package.name))
        _SHIPPED.add(spark.sparkContext.applicationId)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with this package on the executors."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def by_bytes(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of ``batch`` with about ``most`` bytes of ``column`` (one row at least)."""
    lengths = batch.column(column)
    start = total = 0
    for i, value in enumerate(pa.compute.binary_length(lengths).to_pylist()):
        if total and total + (value or 0) > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += value or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from by_bytes(batch, column, most)
