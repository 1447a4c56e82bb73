"""Session set-up and the few helpers that touch the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "placerank", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans rely on (adaptive execution, UTC dates)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; invent one only for a local session without any."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="placerank-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint: later branches read the same rows even
    when an executor is lost in between."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settle(df: DataFrame) -> DataFrame:
    """`materialise` for tables that a loop carries on: the estimated size is forgotten as well.

    A checkpoint keeps the estimate of the plan before it, and a join's estimate is the product of both sides.  A table
    joined with itself each round squares it: after thirty rounds the planner multiplies numbers of a billion digits."""
    kept = materialise(df)
    spark, plan = df.sparkSession, kept._jdf
    rows = spark._jsparkSession.internalCreateDataFrame(plan.queryExecution().toRdd(), plan.schema(), False)
    return DataFrame(rows, spark)


def store(df: DataFrame, name: str) -> DataFrame:
    """`materialise` for wide tables: columns beside the checkpoints, so nulls and repeated values take no room and each
    reader opens only what it needs.  Partitions and their order are not kept."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The rows dealt to all tasks by ``key``, for work that is heavy for every row.

    Rows of few bytes are read in one or two splits, and adaptive execution puts them into few partitions after a shuffle; a
    partition number given here is kept."""
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, key)
