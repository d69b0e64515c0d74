"""Helpers shared by the training-data operators: scratch tables, word hashing, rolling hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than ASCII white space; ``bytes.split()`` cuts just there.
WORD = r"[^\x20\x09-\x0D]+"

_own_folder: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; in local mode, where that is unset, below a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="corvida-"))
        base = _own_folder[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What runs in here leaves no shuffle files: they go when its query ends, not when the driver next collects garbage."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before) if before is not None else spark.conf.unset(_CLEAN)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared scratch folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch table through Hadoop's file system, so that any shared store works."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def delete_table(df: DataFrame) -> None:
    """Remove what ``stored`` wrote, once nothing reads it any more."""
    for path in {file.rpartition("/")[0] for file in df.inputFiles()}:
        delete_path(df.sparkSession, path)


def as_rows(df: DataFrame) -> DataFrame:
    """``df`` as one column ``row``, so that no column that is added clashes with one of its own."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def of_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The table that ``as_rows`` was given."""
    return rows.select(*[F.col("row").getField(c).alias(c) for c in columns])


def row_key(*columns: str | Column) -> Column:
    """A key by content. Repeated rows share it, which is right wherever equal rows get equal answers."""
    return F.xxhash64(*columns)


_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over unsigned integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _C1
    x ^= x >> np.uint64(32)
    x += b * _C2
    x ^= x >> np.uint64(29)
    x *= _C3
    return x ^ (x >> np.uint64(32))


def rolled(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of ``length`` consecutive items, from the items' hashes, by doubling."""
    if len(h) < length:
        return h[:0]
    size = 1
    while size * 2 <= length:
        h = _joined(h[:-size], h[size:])
        size *= 2
    return _joined(h[: len(h) - (length - size)], h[length - size :]) if size < length else h


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive items."""
    size = 1
    while size * 2 <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if size < width else h
