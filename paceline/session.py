"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Recording the Python call site of every column expression takes longer than building it.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "paceline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on. The master comes from spark-submit unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@cache
def _local_root(application: str) -> str:
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path nothing else uses, under the shared folder named by ``spark.checkpoint.dir``.

    Only a local session may do without that setting: on a cluster a folder of one machine would be
    unreadable for the other executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        root = _local_root(spark.sparkContext.applicationId)
    folder = f"{root.rstrip('/')}/paceline-{uuid.uuid4().hex}"
    for made in _OPEN:
        made.append(folder)
    return f"{folder}/{name}"


# Folders made inside each scratch block that is open, innermost last.
_OPEN: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the scratch folders that are made inside the block when it ends.

    Nothing that reads them may be used after it: write or collect results inside.
    """
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield
    finally:
        _OPEN.pop()
        release(spark, made)


def release(spark: SparkSession, folders: list[str]) -> None:
    """Delete scratch folders, through the file system they are on; those that are gone already do not matter."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def report_rows(spark: SparkSession, rows: list[tuple], schema: StructType | str) -> DataFrame:
    """A few measurement rows as a DataFrame.

    Handed over as an Arrow table they become part of the plan; as Python tuples they would be a job of
    their own with a Python worker per task.
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)
    columns = [pa.array([row[i] for row in rows], field.type) for i, field in enumerate(arrow)]
    return spark.createDataFrame(pa.table(columns, schema=arrow), schema)
