"""Session set-up, lineage cuts and the size checks that guard every broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest driver-side object that may be broadcast to the executors.
BROADCAST_BYTES = 512 * 1024 * 1024


def get_spark(app: str = "sparkvec", cores: str = "*", shuffle_partitions: int | None = None,
              **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if cores:
        builder = builder.master(f"local[{cores}]").config("spark.driver.memory", "8g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a scratch folder only on a local master."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        current = tempfile.mkdtemp(prefix="sparkvec-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store `df` as a table in the shared checkpoint folder and read it from there.

    Unlike a plain checkpoint the copy is columnar, so later reads prune columns and the
    optimiser knows its size.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/sparkvec-stage-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hadoop_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop_path(spark, path)
    return fs.exists(p)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of a folder's files and folders; none if it isn't there."""
    fs, p = _hadoop_path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def touch(spark: SparkSession, path: str) -> None:
    """Make an empty file, which is there or not there, never half."""
    fs, p = _hadoop_path(spark, path)
    fs.create(p, True).close()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder this package wrote."""
    fs, p = _hadoop_path(spark, path)
    fs.delete(p, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(scan: DataFrame) -> DataFrame:
    """A file scan with at least as many partitions as the session has cores.

    Only a scan of few, unsplittable files is moved; a scan that already fills the cluster
    stays where it is. Meant for plain scans ahead of heavy per-row work.
    """
    want = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(want) if scan.rdd.getNumPartitions() < want else scan


def row_stats(df: DataFrame, array_col: str, bytes_per_element: int) -> tuple[int, int]:
    """(rows, approximate bytes) of a frame whose weight lies in one array column."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(array_col)).alias("e")).first()
    return int(row["n"]), int(row["e"] or 0) * bytes_per_element + int(row["n"]) * 8
