"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType, TimestampType


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where that is unset, a local session takes a folder of this machine for the
    rest of the session; on a cluster, whose executors would each write to their
    own disks, a RuntimeError is raised.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        kept = context._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            found = kept.get()
        elif re.match(r"local(\[|$)", context.master):
            found = "file://" + tempfile.mkdtemp(prefix="cellwise-")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A path of its own in the shared folder, deleted when the driver's JVM ends.

    Results are lazy, so what they read can't go earlier; ``discard`` of a frame
    that nothing reads any more does it at once.
    """
    folder = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    system.mkdirs(path)  # what doesn't exist can't be marked for deletion
    system.deleteOnExit(path)
    return f"{folder}/data"


def staged(df: DataFrame, tag: str = "staged") -> DataFrame:
    """The rows, written once as Parquet and read from there.

    Cuts the lineage as ``checkpoint()`` does, in columnar form, and survives the
    loss of any executor. For tables that several branches of a plan read after
    costly expressions: each branch would compute them again, and the optimiser
    would copy them into filters.
    """
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few rows of the driver's, by Arrow: they are part of the plan, where a list would start Python workers."""
    fields = StructType.fromDDL(schema).fields
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    # collect() gives timestamps in the driver's time zone, without naming it.
    moments = [
        [v.astimezone(timezone.utc) if isinstance(v, datetime) and isinstance(f.dataType, TimestampType) else v for v in c]
        for f, c in zip(fields, columns, strict=True)
    ]
    table = pa.Table.from_arrays([pa.array(c) for c in moments], names=[f.name for f in fields])
    return spark.createDataFrame(table, StructType(fields))
