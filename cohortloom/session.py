"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_TASK = 500_000
_LOCAL_FOLDERS: dict[SparkSession, str] = {}


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cohortloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one the cluster names, else a local one in local mode (tests).

    On a cluster a folder of this machine would hold only what this machine wrote,
    so there an unset folder is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.conf.get("spark.master", "").split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if spark not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[spark] = tempfile.mkdtemp(prefix="spark-tables-")
    return _LOCAL_FOLDERS[spark]


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows hashed over at least one partition per core.

    For steps whose work per row is far larger than the row, which size-based
    coalescing would otherwise pack into a few tasks.
    """
    spark = df.sparkSession
    partitions = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # hashing the hash: Spark drops a repartition its input already satisfies, and then coalesces
    return df.repartition(partitions, F.xxhash64(F.col(key)))


def partitions_for(spark: SparkSession, rows: int) -> int:
    """Partitions that hold at most ROWS_PER_TASK of the rows on average, so a task's memory stays as the tables grow."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))


def settle(df: DataFrame) -> DataFrame:
    """Write a table that several branches of a plan read, and read it back.

    Floating sums depend on arrival order, so a recomputed branch may differ in
    the last bit; ranks and joins on such values need one fixed copy.  A written
    table survives executor loss, keeps column pruning and filters at the scan,
    and tells the planner its size, so only sides under Spark's own broadcast
    threshold are broadcast.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle_by(df: DataFrame, key: str, partitions: int) -> DataFrame:
    """Write a table dealt by ``key``: joins and groupings by the key with tables dealt alike move no rows again."""
    name = f"table_{uuid.uuid4().hex}"
    (df.repartition(partitions, key).write.format("parquet").bucketBy(partitions, key)
     .option("path", f"{shared_folder(df.sparkSession)}/{name.replace('_', '-')}").saveAsTable(name))
    return df.sparkSession.table(name)
