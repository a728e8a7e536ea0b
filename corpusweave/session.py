"""Session settings for local runs, and the folder that all executors can reach."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_scratch: list[str] = []


def local_session(cores: int | str = 8, app: str = "corpusweave") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the submitter sets these."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only for a local master without it."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="corpusweave-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    _scratch.append(path)
    return path


def delete_scratch(spark: SparkSession, path: str) -> None:
    """Delete a path of :func:`scratch_path`, in whatever file system it lies."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    if path in _scratch:
        _scratch.remove(path)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """On leaving, delete the scratch tables made inside; what reads them must have been written by then."""
    before = set(_scratch)
    try:
        yield
    finally:
        for path in [p for p in _scratch if p not in before]:
            delete_scratch(spark, path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so iterative plans stay short and survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def set_down(df: DataFrame, name: str) -> DataFrame:
    """The rows written as a scratch table and read again: one run of the plan, and unlike a checkpoint
    nothing of what the optimiser inferred from it is carried into the next round of a loop."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="corpusweave-zip-"), "corpusweave")
    archive = shutil.make_archive(
        target, "zip", root_dir=os.path.dirname(root), base_dir=os.path.basename(root)
    )
    context.addPyFile(archive)  # Spark copies it to the executors
    _shipped.add(context.applicationId)
