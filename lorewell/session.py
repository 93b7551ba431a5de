"""Session defaults and the shared folder that cut lineage goes to."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", app: str = "lorewell", **conf: str) -> SparkSession:
    """A session with the defaults the engine relies on: UTC, AQE and Arrow."""
    builder = SparkSession.builder.master(master).appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
    }
    return builder.config(map=defaults | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Gives the executors' Python this package, once a context."""
    context = spark.sparkContext
    if getattr(context, "_lorewell_shipped", False):
        return
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="lorewell-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(f"{folder}/lorewell", "zip", here.parent, here.name))
    context._lorewell_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a folder of our own only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lorewell-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_SCRATCH: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; removed when the driver ends, as results may be read until then."""
    path = f"{shared_dir(spark)}/lorewell/{label}-{uuid.uuid4().hex}"
    if not _SCRATCH:
        atexit.register(_sweep)
    _SCRATCH.append((spark, path))
    return path


def _sweep() -> None:
    for spark, path in _SCRATCH:
        try:
            drop_path(spark, path)
        except Exception:  # the session has ended: the folder's owner cleans up
            return


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a folder that ``scratch_path`` named."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: lineage is cut and the loss of an executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
