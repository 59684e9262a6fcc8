"""Session matters: where lineage is cut."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, types as T


def shared_folder(spark: SparkSession) -> str:
    """The reliable folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own; a cluster without it is an error,
    because executors cannot share a machine-local path.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="parapet-")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one; Hadoop removes it when the driver's JVM ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write the result once to the shared folder and go on from there; survives the loss of executors.

    A table, not ``checkpoint()``, which would compute the last stage twice: once to count, once to write.
    """
    spark = df.sparkSession
    if any(isinstance(f.dataType, T.NullType) for f in df.schema.fields):  # no file format has a column without a type
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(shared_folder(spark))
        return df.checkpoint()
    path = new_folder(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the session's executors, once; they need no installed copy and no PYTHONPATH."""
    context = spark.sparkContext
    if getattr(context, "_parapet_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    if package.parent.is_dir():  # not from a zip, which is on the executors already
        target = Path(tempfile.mkdtemp(prefix="parapet-code-")) / "parapet.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for file in sorted(package.rglob("*.py")):
                archive.write(file, file.relative_to(package.parent))
        context.addPyFile(str(target))
    context._parapet_shipped = True
