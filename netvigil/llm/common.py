"""What several of the text operators share."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import netvigil
from netvigil.session import work_path

# Fixed by the contract: white space is space and \t to \r; letters are lowered in A-Z only.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SUM_GROUPS = 64
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) that depends on the parts only, so that reruns agree."""
    columns = [F.lit(p) if isinstance(p, int) else p for p in parts]
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) * F.lit(2.0**-53)


def text_hash(name: str = "text") -> Column:
    return F.xxhash64(text_or_empty(name))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the cluster's shared folder and read back: cuts lineage, survives lost executors."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that run inside go when each ends, not when the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def summed(rows: DataFrame, kind: str) -> DataFrame:
    """(key, numbers): vectors of numbers of a numpy kind added up per key, in two steps so
    that no task takes in what all tasks have made.

    ``rows`` has (key bigint, numbers binary).
    """

    def add(
        key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]
    ) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column("numbers").to_pylist():
                vector = np.frombuffer(raw, kind)
                total = vector.copy() if total is None else total + vector
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.int64()), pa.array([total.tobytes()], pa.binary())],
            ["key", "numbers"],
        )

    kinds = "key bigint, numbers binary"
    part = F.spark_partition_id() % SUM_GROUPS
    partial = rows.groupBy("key", part.alias("part")).applyInArrow(add, kinds)
    return partial.groupBy("key").applyInArrow(add, kinds)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Spark hand this package to its Python workers, once per session's context."""
    context = spark.sparkContext
    if getattr(context, "_netvigil_shipped", False):
        return
    root = Path(netvigil.__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="netvigil-code-")) / "netvigil.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._netvigil_shipped = True
