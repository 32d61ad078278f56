"""Session settings, table access and shared checkpoint storage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "corvane", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the engine expects; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``, be it one file or a folder of files."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in spark.checkpoint.dir; where it is unset make one here, in local mode (tests) only."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="corvane-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there, so that lost executors cost no lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    # A checkpoint keeps its plan's partitioning, though adaptive execution may have coalesced it; a union that trusts the
    # partitioning of its inputs then fails on their differing numbers of partitions.
    df.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: like ``cut``, but reads prune columns, partitions and rows."""
    spark = df.sparkSession
    path = shared_folder(spark, "table")
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_active() -> None:
    """``ship`` for the session at hand, if there is one: for column functions, which have no DataFrame to ask."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship(spark)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once: they need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_corvane_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="corvane-code-")) / "corvane.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    sc.addPyFile(str(archive))  # the driver serves it to the executors
    sc._corvane_shipped = True
