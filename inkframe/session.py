"""Spark sessions, and the package on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of one Arrow batch on its way to or from a Python worker, unless a single row is larger.
BATCH_BYTES = 8 << 20
_shipped: set[str] = set()


def session(cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """A local session with the settings that the tests and the benchmark use."""
    n = str(os.cpu_count() if cores == "*" else cores)
    settings = {"spark.sql.shuffle.partitions": n, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": memory}
    spark = SparkSession.builder.master(f"local[{cores}]").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, so that Python workers import it wherever they run, and bound their batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="inkframe-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt evenly, or by ``keys``, to as many tasks as a shuffle has, which aren't put together again: for work that takes much longer than its bytes suggest.

    Without keys a table that already has so many partitions stays as it is.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not keys and df.rdd.getNumPartitions() >= n:
        return df
    return df.repartition(n, *keys)
