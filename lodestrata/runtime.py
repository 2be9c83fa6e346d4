"""Session helpers that every operator shares."""

from __future__ import annotations

import io
import os
import re
import tempfile
import zipfile

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers through the shared folder, once an application, as they may not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root, packed = os.path.dirname(os.path.abspath(__file__)), io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), os.path.dirname(root)))
    base = shared_dir(spark)
    system, where = fs.FileSystem.from_uri(base if ":" in base else f"file://{base}")
    system.create_dir(where, recursive=True)
    with system.open_output_stream(f"{where}/lodestrata.zip") as out:
        out.write(packed.getvalue())
    sc.addPyFile(f"{base}/lodestrata.zip")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors see: spark.checkpoint.dir. Only where the executors are this process may it be unset: then it is a temporary folder."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError(f"spark.checkpoint.dir has to name a folder that all executors of {sc.master} share")
    sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="lodestrata-"))
    return sc._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate files, wherever it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Run ``df`` once and go on from a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    """The session's shuffle width; deployments set it in proportion to their input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over the session's shuffle width if its scan has fewer tasks, as of one small file; else as it is."""
    width = partitions(df.sparkSession)
    return df.repartition(width) if df.rdd.getNumPartitions() < width else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that ``df`` doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out
