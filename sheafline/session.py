"""Session defaults and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "sheafline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Nothing here fixes a cluster size: AQE coalesces and splits shuffle partitions at run time, and
    Spark's own size check (``spark.sql.autoBroadcastJoinThreshold``) decides what is broadcast.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    A machine-local folder is used only in local mode with the setting unset; on a cluster without
    the setting this fails rather than write where other executors cannot read.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="sheafline-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back; ``options`` are the writer's.

    Cuts the lineage with files that outlive a lost executor; used where a result feeds several
    plans and must not be computed (or scored) twice.
    """
    path = scratch_dir(df.sparkSession)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, partitions: int | None) -> DataFrame:
    """``partitions`` tasks for a Python stage that is heavy per byte; None leaves the table as it is.

    Partitions are cut by bytes, so a small table may be a single task. The number is the caller's:
    looking at the plan's partitions would run its shuffles.
    """
    return df if partitions is None else df.repartition(partitions)


def parallelism(spark: SparkSession) -> int:
    """Tasks that can run at once, as configured."""
    return spark.sparkContext.defaultParallelism


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers (once per SparkContext)."""
    sc = spark.sparkContext
    if getattr(sc, "_sheafline_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="sheafline-")) / "sheafline.zip"
    with zipfile.ZipFile(archive, "w") as packed:
        for source in sorted(root.rglob("*.py")):
            packed.write(source, str(source.relative_to(root.parent)))
    sc.addPyFile(str(archive))
    sc._sheafline_shipped = True
