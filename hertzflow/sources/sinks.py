"""Sinks: versioned Parquet tables, published folders and CSV slices."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import between

_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def version_key(start, end, logic_version: str) -> str:
    """Key of a derived table: its date range and the version of the logic."""
    return f"{start}_to_{end}_{hashlib.md5(logic_version.encode()).hexdigest()[:8]}"


def materialised(
    spark: SparkSession,
    root: str,
    start,
    end,
    logic_version: str,
    build: Callable[[], DataFrame],
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Read the table of this range and version, building it first if absent.

    Older versions stay; nothing is deleted implicitly. A half-written table has
    no schema footer and no success marker, and is built again.
    """
    path = f"{root.rstrip('/')}/range={start}_{end}/version={version_key(start, end, logic_version)}"
    try:
        spark.read.text(f"{path}/_SUCCESS").schema
        return spark.read.parquet(path)
    except AnalysisException:
        build().write.mode("overwrite").partitionBy(*partition_by).parquet(path)
        return spark.read.parquet(path)


_MANIFEST = "key string, folder string, at double"


def content_key(**parts) -> str:
    """One key of everything that decides a result."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:16]


def newest(spark: SparkSession, root: str, key: str | None = None) -> str | None:
    """The folder published last under ``root``, for ``key`` or at all; None if there is none."""
    try:
        rows = spark.read.schema(_MANIFEST).json(f"{root.rstrip('/')}/manifest")
    except AnalysisException:
        return None
    rows = rows.where(F.col("key") == key) if key is not None else rows
    last = rows.agg(F.max_by("folder", F.struct("at", "folder"))).first()[0]
    return last and f"{root.rstrip('/')}/{last}"


def published(spark: SparkSession, root: str, key: str, write: Callable[[str], None], *, reuse: bool = True) -> str:
    """The folder published for ``key``, with what ``write`` makes if there is none.

    ``write`` fills a fresh folder with as many tables and models as it likes. Only when it has
    returned is the folder named in the manifest, a table to which one file is added, so readers
    see a version whole or not at all: a crash leaves the older version published and an unnamed
    folder behind. Nothing is deleted. Two jobs that make one key at a time both publish a whole
    folder, and readers take the later one.
    """
    root = root.rstrip("/")
    found = newest(spark, root, key) if reuse else None
    if found is None:
        folder = f"v-{uuid.uuid4().hex}"
        write(f"{root}/{folder}")
        row = [(key, folder, time.time())]
        spark.createDataFrame(row, _MANIFEST).coalesce(1).write.mode("append").json(f"{root}/manifest")
        found = f"{root}/{folder}"
    return found


def write_csv_slice(df: DataFrame, path: str, column: str, start, end) -> None:
    """Rows of [start, end], both ends included, as CSV parts with a header."""
    writer = between(df, column, start, end).write.mode("overwrite")
    # The default text form drops the microseconds.
    writer = writer.options(timestampFormat=_MICROS + "XXX", timestampNTZFormat=_MICROS)
    writer.csv(path, header=True)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str]) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
