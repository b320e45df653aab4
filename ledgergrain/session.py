"""Session helpers: a local session for tests and benchmarks, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FOLDERS: list[tempfile.TemporaryDirectory] = []


def local_session(cores: int | str = 8, app: str = "ledgergrain", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own.

    Its checkpoint folder is a temporary one that goes when Python ends, unless ``conf`` names another.
    """
    if "spark.checkpoint.dir" not in conf:
        _LOCAL_FOLDERS.append(tempfile.TemporaryDirectory(prefix="ledgergrain-", ignore_cleanup_errors=True))
        conf = {**conf, "spark.checkpoint.dir": _LOCAL_FOLDERS[-1].name}
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset, a folder in the warehouse, which is shared too."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def application_folder(spark: SparkSession, name: str) -> str:
    """One path for all of an application's tables of a kind."""
    return f"{shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}"


def run_folder(spark: SparkSession, name: str) -> str:
    """A fresh path for one run's tables or streaming state.

    All of an application lie in one folder below the shared one, which can go when the application has ended.
    """
    return f"{application_folder(spark, name)}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise to the shared folder, so that later use survives lost executors and never recomputes."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
