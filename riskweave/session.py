"""Session defaults and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
SPREAD_KEY = "riskweave.spread"


def local_session(cores: int | str = 8, **conf) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("riskweave")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder all executors share.

    The cluster names that folder in ``spark.checkpoint.dir``.  Only where it is
    unset on one machine (tests) is a temporary folder made and remembered in
    the session; on a cluster executors would write to disks of their own.
    """
    base = spark.conf.get(CHECKPOINT_KEY, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="riskweave-")
        spark.conf.set(CHECKPOINT_KEY, base)
    return os.path.join(base, name, uuid.uuid4().hex)


def spread(scan: DataFrame) -> DataFrame:
    """A scan dealt out to all cores, in sessions that ask for it (``riskweave.spread``).

    A small table lies in one file with one row group, and one task would do all the
    work.  Benchmarks on such tables turn this on; by default plans are those of any size.
    """
    spark = scan.sparkSession
    if spark.conf.get(SPREAD_KEY, "false") != "true":
        return scan
    return scan.repartition(spark.sparkContext.defaultParallelism)


def enough_tasks(df: DataFrame, rows_per_task: int) -> int:
    """As many tasks as keep the rows of each bounded, whatever the number of shuffle partitions; one per core at least.

    Counting reads no columns.  Asked for by number, the tasks are not merged again.
    """
    return max(2, df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows_per_task))


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Used between the stages of long procedures: a lost executor then costs a
    re-read, not a re-fit, and the plan of the next stage starts small.
    """
    spark = df.sparkSession
    path = work_folder(spark, name)
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
