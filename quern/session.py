"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(cpus: str = "8", app: str = "quern", **conf: str) -> SparkSession:
    """Local session with the settings the operators expect (UTC, AQE, Arrow)."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only on a local master, where that is unset
    (tests, local runs), a temporary one is made; elsewhere a folder of one machine would lose
    data with it, so an unset folder is an error.
    """
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    now = sc.getCheckpointDir()
    if given:
        if not now:
            sc.setCheckpointDir(given)
        return given
    if not now:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quern-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as a table into the shared folder and read from there.

    Columnar, so later steps read only the columns they need; rows keep no order. The folder
    belongs to whoever set it; a table is not removed before the folder is.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the project's parquet tables.

    A table that is read in fewer tasks than there are cores (one small file) is spread over
    them; larger ones already are, and stay as they are. Filters and columns still reach the scan.
    """
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    cores = spark.sparkContext.defaultParallelism
    tasks = df.rdd.getNumPartitions()
    return df.repartition(cores) if tasks < cores else df
