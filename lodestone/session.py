"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", app: str = "lodestone", **conf: str) -> SparkSession:
    """A session with the settings the operators expect; everything else stays with the cluster."""
    builder = SparkSession.builder.appName(app).master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Only where it is unset and all runs on one
    machine, a temporary folder is made and set; on a cluster an unset folder is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_open: list[list[str]] = []  # the paths made within each scratch()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """All paths made within it are removed at its end, so that a driver that lives long doesn't fill the shared folder. What is
    computed within must be written or collected before it ends."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which is removed when the driver ends, or the scratch() it was made in."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    return out


def materialize_parts(df: DataFrame, name: str, part: str) -> DataFrame:
    """The same with a folder for each value of a column of few values: a filter on it reads these folders only."""
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(part).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(df.columns)


def discard(df: DataFrame) -> None:
    """Remove what materialize() wrote for this frame, once nothing reads it any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._lodestone_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ship(spark: SparkSession) -> None:
    """Hand the package to the Python workers, once for a context: they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_lodestone_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="lodestone-code-"), "lodestone.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("lodestone", os.path.relpath(path, package)))
    context.addPyFile(target)
    context._lodestone_shipped = True
