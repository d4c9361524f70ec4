"""Session helpers: a tuned local session, and shipping this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Rows and bytes of an Arrow batch: texts are long, and a worker holds a whole batch at a time.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def ship(spark: SparkSession) -> None:
    """Make this package importable in every Python worker of ``spark`` (once per application).

    Arrow batches are made smaller unless the session or its application sets their size.
    """
    sc = spark.sparkContext
    own = spark.conf.getAll
    for key, value in BATCH.items():
        if key not in own:
            spark.conf.set(key, value)
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    fd, name = tempfile.mkstemp(prefix="lexiforge-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(name)
    _shipped.add(sc.applicationId)


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for one machine; on a cluster, bring your own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("lexiforge")
        .config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.adaptive.enabled", "true")
        .getOrCreate())
