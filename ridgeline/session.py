"""Session helpers shared by every part of the library."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once, so that functions in tasks can import it."""
    context = spark.sparkContext
    if getattr(context, "_ridgeline_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="ridgeline-")
    target = os.path.join(folder, "ridgeline.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, Path(ROOT.name) / p.relative_to(ROOT))
    context.addPyFile(target)
    context._ridgeline_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Only where that is unset and all runs on this machine, as in tests, a folder of it is taken.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.split("[")[0] == "local":
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="ridgeline-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: later plans start from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read again.

    Unlike cut() it forgets what was estimated: in a loop of joins of a table with itself the
    estimates of its size would be squared each time, to numbers of millions of digits.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; any path that Spark's readers open will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
