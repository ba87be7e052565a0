"""Session settings and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"

_LOCAL_ROOTS: dict[str, str] = {}

# Row bound under which a table of keys may be broadcast.
BROADCAST_ROWS = 500_000


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("orderlight")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, as named by the cluster.

    Only a local master may fall back to a fresh temporary folder: on a cluster the
    executors do not share one, so an unset folder is an error there.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors can reach")
    # A core key cannot be set on a running session, so the folder is remembered here, per application.
    if context.applicationId not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[context.applicationId] = tempfile.mkdtemp(prefix="orderlight-")
    return _LOCAL_ROOTS[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def release_shuffles(spark: SparkSession) -> None:
    """From now on the shuffle files of a query go when it ends. Otherwise they stay until the driver happens to collect
    its garbage, and a job of many steps holds those of all its steps."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def stored(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back.

    Used where a result is read more than once or where row positions must not change
    between two reads. Losing an executor afterwards costs a re-read, not a recompute.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    release_shuffles(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if its counted size is within ``bound``; otherwise leave the join
    to the shuffle (sort-merge with adaptive skew splitting)."""
    return F.broadcast(df) if df.count() <= bound else df
