"""Tables and files that all executors see: in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: While a table is written: Python workers get few rows at a time, and long plans are described in short for the driver, which keeps descriptions.
WRITING = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.maxPlanStringLength": "20000", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset, a temporary folder, for a local master only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='folioscope-core-')}"
        path = _own[context.applicationId]
    return path.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """The session's settings while tables are written; they are as before afterwards."""
    before = {k: spark.conf.get(k, None) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def kept(df: DataFrame, path: str, sort: list[str] | None = None, ranges: list[str] | None = None) -> DataFrame:
    """df written as a Parquet table and read again, dealt by ranges of some columns and sorted if these are given; later stages don't depend on what made it."""
    out = df.repartitionByRange(*ranges) if ranges else df
    with writing(df.sparkSession):
        (out.sortWithinPartitions(*sort) if sort else out).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The store that a URI or path names, and the path there."""
    if not urlparse(path).scheme:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


def let_go() -> None:
    """Give a Python worker's memory that nothing holds back to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)
