"""Table access and lineage cuts used by every operator."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_STORED: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named by spark.checkpoint.dir. Without one a local session (tests) gets a folder of its own; on a
    cluster that is an error, since what an executor wrote to its own disk the others would miss."""
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set(CHECKPOINT_DIR, folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df once to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _STORED:
        atexit.register(_release_at_exit, spark)
    _STORED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the stored tables of this driver, once the results that read them are written; returns how many there were."""
    paths = [_STORED.pop() for _ in range(len(_STORED))]
    for path in map(spark._jvm.org.apache.hadoop.fs.Path, paths):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


def _release_at_exit(spark: SparkSession) -> None:
    """Nothing is read any more when the driver ends; a JVM that is gone already leaves the tables to the cluster's own cleaning."""
    with contextlib.suppress(Exception):
        release(spark)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df does not use (names are compared without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per session, as spark-submit --py-files does: their Python need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_assayloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="assayloom-")) / "assayloom.zip"  # on the driver; Spark serves it from there
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._assayloom_shipped = True
