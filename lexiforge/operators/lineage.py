"""Cutting lineage in rounds of joins."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame

_folders: dict[str, str] = {}
#: Rows of a table that a task takes on the average at most.
TASK_ROWS = 250_000


def _folder(sc) -> str:
    """This application's folder below ``spark.checkpoint.dir``, or a local one where none is set and the master is local; it goes when the driver ends."""
    if sc.applicationId not in _folders:
        at = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
        if at is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        name = f"{at or tempfile.mkdtemp(prefix='lexiforge-')}/rounds-{uuid.uuid4().hex}"
        path = sc._jvm.org.apache.hadoop.fs.Path(name)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _folders[sc.applicationId] = name
    return _folders[sc.applicationId]


def cut(df: DataFrame, **options: str) -> DataFrame:
    """``df`` written as a table and read again. A checkpoint would keep the constraints of its plan, which double from round to round."""
    spark = df.sparkSession
    name = f"{_folder(spark.sparkContext)}/{uuid.uuid4().hex}"
    df.write.parquet(name, **options)
    return spark.read.schema(df.schema).parquet(name)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt by their keys to as many tasks as they need, so that a task's memory doesn't grow with the table. The rows are counted: meant for tables as they are read."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, math.ceil(rows.count() / TASK_ROWS)), *keys)
