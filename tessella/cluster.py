"""Making the package importable on executors; intermediates written once in the folder that all share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Adds this package to the Python path of the session's executors, once for each Spark application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    place = os.path.join(tempfile.mkdtemp(prefix="tessella-"), f"{root.name}_src.zip")
    with zipfile.ZipFile(place, "w", zipfile.ZIP_DEFLATED) as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(place)
    _SHIPPED[app] = place


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which the driver and all executors share; only a local session may do without the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tessella-")
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def settle(rows: DataFrame) -> DataFrame:
    """rows written as Parquet in the shared folder and read again.

    Unlike a checkpoint this makes the rows once, not twice, and what is planned on top sees the files' sizes, not the product of those of all
    that was joined before, whose digits double with each round of a loop.
    """
    spark, path, schema = rows.sparkSession, f"{shared_folder(rows.sparkSession)}/{uuid.uuid4().hex}", rows.schema
    rows.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Deletes the files of settled rows that nothing reads any more."""
    for rows in frames:
        for file in rows.inputFiles()[:1]:
            folder = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
