"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "cuemill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC times; every other setting stays the cluster's."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder path below ``spark.checkpoint.dir``, the one all executors can reach.

    Only a local session without that setting falls back to a temporary folder: on a cluster a
    machine-local folder would be lost with its machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="cuemill-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the scratch folder and read back, for what several passes need."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Lets Python workers import this package where their path does not hold its folder.

    A package found through PYTHONPATH or the working folder, or sent along with ``--py-files``, is
    left alone; otherwise its modules go to the executors once per application.
    """
    home = os.path.dirname(os.path.abspath(__file__))
    root, name = os.path.split(home)
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    context = spark.sparkContext
    if root in known or os.path.abspath(os.getcwd()) == root or not os.path.isdir(home) or any(
            f.endswith(f"/{name}-package.zip") for f in context.listFiles):
        return
    # A file of the driver: Spark serves it to the executors.
    path = os.path.join(tempfile.mkdtemp(prefix=f"{name}-"), f"{name}-package.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, files in os.walk(home):
            for file in files:
                if file.endswith(".py"):
                    full = os.path.join(folder, file)
                    archive.write(full, os.path.relpath(full, root))
    context.addPyFile(path)
