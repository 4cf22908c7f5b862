"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: dict[str, str] = {}

#: Rows with texts that one task sorts or groups, about.
TASK_ROWS = 8192
_LEAST_TASKS = 8


def local_session(cores: int | str = "*", app_name: str = "folioscope", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )


def work_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` where it is set.

    Only a session without that setting (a local test) falls back to a folder of
    its own, because a machine-local folder is not visible to other executors.
    The path is fresh per application, so runs never read each other's tables.
    """
    app = spark.sparkContext.applicationId
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return f"{shared.rstrip('/')}/folioscope-{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="folioscope-")
    return _own_folder[app]


def fresh_folder(spark: SparkSession, label: str) -> str:
    return f"{work_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the work folder and read back, which cuts its lineage.

    The files outlive the executors that wrote them, and their size tells Spark whether
    a join may broadcast them.
    """
    folder = fresh_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def dealt(df: DataFrame, rows: int, *keys: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """``df``, of about ``rows`` rows, by ``keys`` in as many tasks as keep each at about ``task_rows``.

    Without a number Spark merges partitions until there are about as many as cores, so that what
    a task sorts grows with the table.
    """
    return df.repartition(max(_LEAST_TASKS, 1 + rows // task_rows), *keys)
