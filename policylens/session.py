"""Session settings, the one place that cuts lineage, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings the jobs are written for.  AQE turns a shuffled join into a broadcast join only
#: after it has measured the small side, and splits join partitions held by a hot key.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # do not record the Python call site of every Column; it doubles the time to build a plan
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: str = "8", app: str = "policylens", **extra: str) -> SparkSession:
    """A local session for tests and the bench; a cluster passes SETTINGS to spark-submit."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": cores,
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        **extra,
    }
    for name, value in conf.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    It comes from `spark.checkpoint.dir`.  Only a local session without one gets a temporary
    folder; on a cluster a missing setting is an error, because a folder on one machine would be
    lost with it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="policylens-ckpt-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialize `df` in the shared folder and end its lineage there."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a written table, inside the shared checkpoint folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: computed once, columns still pruned."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes (as JSON) up to which a table with one row per key is copied to every executor.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20


def attach(df: DataFrame, per_key: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """`df` joined (inner or left) to a table with one row per key, without moving `df` when that is safe.

    The table is written once, its rows counted and their size summed: a small one is broadcast,
    a large one is joined by shuffle, where AQE splits hot keys.
    """
    per_key = checkpointed(per_key)
    width = F.octet_length(F.to_json(F.struct(*per_key.columns)))
    rows, size = per_key.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    small = rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES
    return df.join(F.broadcast(per_key) if small else per_key, keys, how)
