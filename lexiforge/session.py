"""Sessions, lineage cuts and the few scale helpers that several operators share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A side is broadcast only if it has at most so many rows; beyond, joins shuffle.
BROADCAST_ROWS = 200_000


def get_session(app: str = "lexiforge", cores: str = "*") -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LEXIFORGE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where a local session has none
    (tests on one machine), a temporary folder of this machine is set; on a cluster that raises."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        have = sc._jsc.sc().getCheckpointDir()
        if have.isDefined():
            return have.get()
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lexiforge-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared folder, so that what follows reads them again
    instead of computing them again, also after an executor is lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_table(df: DataFrame, name: str) -> DataFrame:
    """As cut(), as a Parquet table: columns and row groups can be pruned by its readers."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count finds at most so many rows, else unchanged."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """df by hash over all shuffle partitions, however few bytes it has: for work in Python that takes
    far longer than its rows are large. A given number of partitions is not coalesced again."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *cols)


def widen(df: DataFrame) -> DataFrame:
    """df over all cores if its files are too few and too small to give each core a part; else as it
    is, without a shuffle. Judged from the plan alone; nothing runs."""
    spark = df.sparkSession
    files, cores = len(df.inputFiles()), spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    part = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.repartition(cores) if 0 < files and max(files, size // part) < cores else df


def hash_order(*cols: Column | str, seed: int = 7) -> Column:
    """A random order that neither partitions nor restarts change: a hash of the key and a seed."""
    return F.xxhash64(F.lit(seed), *[F.col(c) if isinstance(c, str) else c for c in cols])


def md5_order(key: Column | str, seed: int = 7) -> Column:
    """As hash_order, as 32 hexadecimal digits that SQL engines make alike."""
    return F.md5(F.concat(F.lit(str(seed)), (F.col(key) if isinstance(key, str) else key).cast("string")))


def leading(digits: Column, n: int) -> Column:
    """The first n hexadecimal digits of a text as a number."""
    return F.conv(F.substring(digits, 1, n), 16, 10).cast("long")


def ranged(df: DataFrame, *order: Column) -> DataFrame:
    """df by ranges of `order`, written, with the range's number in `_range`: a bucket for `running`. The
    ranges are drawn from a sample, so they must not be drawn again by another reader."""
    return cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))


def running(df: DataFrame, group: list[str], order: list[Column], bucket: Column, value: Column, out: str, keep_bucket: bool = False) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the group up to and including this row.

    `bucket` is a number that never falls along `order`. Only rows of one (group, bucket) meet in a
    task; sums of whole buckets are carried over through a small table of buckets, so a group that
    holds a third of all rows is spread over as many tasks as it has buckets."""
    d = df.withColumn("_bucket", bucket).withColumn("_value", value)
    sums = d.groupBy(*group, "_bucket").agg(F.sum("_value").alias("_sum"))
    before = W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    left, right = d.alias("l"), sums.alias("r")
    on = [F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in group] + [F.col("l._bucket").eqNullSafe(F.col("r._bucket"))]
    d = left.join(right, on).select("l.*", "r._before")
    within = W.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn(out, F.sum("_value").over(within) + F.col("_before"))
    return d.drop("_value", "_before", *([] if keep_bucket else ["_bucket"]))
