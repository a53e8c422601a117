"""Cutting lineage and choosing join strategies by measured size.

Tables that a plan reads more than once are written as Parquet below the folder
named by ``spark.checkpoint.dir`` (shared by driver and executors), so a lost
executor costs only the re-read of a file.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Application id -> folder, for sessions that name none.
_OWN: dict[str, str] = {}

#: Rows that a broadcast side may hold at most; larger sides are shuffled.
BROADCAST_ROWS = 500_000
#: Bytes (estimated from a row's width) that a broadcast side may hold at most.
BROADCAST_BYTES = 48 << 20

#: Rows of an Arrow batch while a table is written.
ARROW_ROWS = 2_000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: that of ``spark.checkpoint.dir``, or of the context's checkpoints.

    Where none is named, a temporary folder serves a local master; on a cluster,
    whose executors couldn't see it, that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    of_context = spark.sparkContext._jsc.sc().getCheckpointDir()
    if of_context.isDefined():
        return of_context.get().rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="weftmesh-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return f"file://{_OWN[app]}"


@contextlib.contextmanager
def _short_batches(spark: SparkSession) -> Iterator[None]:
    """At most ARROW_ROWS rows are handed to Python at once: whole texts and arrays make long rows."""
    before = spark.conf.get(_ROWS, "10000")
    spark.conf.set(_ROWS, str(min(int(before), ARROW_ROWS) if int(before) > 0 else ARROW_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back.

    An empty ``df`` gives an empty table with the same schema.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftmesh/{name}-{uuid.uuid4().hex}"
    with _short_batches(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that nothing reads any more; other tables are left alone."""
    for table in tables:
        path = getattr(table, "written_to", None)
        if path:
            spark = table.sparkSession
            file = spark._jvm.org.apache.hadoop.fs.Path(path)
            file.getFileSystem(spark._jsc.hadoopConfiguration()).delete(file, True)


def extended(schema: StructType, fields: str) -> StructType:
    """A copy of ``schema`` with the fields of a DDL string added."""
    return StructType([*schema.fields, *StructType.fromDDL(fields).fields])


def small_enough(df: DataFrame, row_bytes: int) -> bool:
    """True if ``df`` (which should be materialized) may be broadcast."""
    limit = min(BROADCAST_ROWS, BROADCAST_BYTES // max(1, row_bytes))
    return df.limit(limit + 1).count() <= limit


def sized_join(left: DataFrame, right: DataFrame, on: Column | list[str] | str, how: str, row_bytes: int = 64) -> DataFrame:
    """Join with ``right`` broadcast if its counted rows allow it, shuffled otherwise."""
    if small_enough(right, row_bytes):
        right = F.broadcast(right)
    return left.join(right, on, how)
