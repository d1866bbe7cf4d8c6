"""Session plumbing shared by the operators of this package."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a temporary folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not (own := getattr(spark.sparkContext, "_gradeloom_dir", None)):
        own = spark.sparkContext._gradeloom_dir = "file://" + tempfile.mkdtemp(prefix="gradeloom-")
    return own


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage is cut, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def least_hashes(rows: DataFrame, order: str, n: int) -> int | None:
    """The ``n``-th least value of a column of 64-bit hashes, or the largest if there are fewer; None without rows.

    Of more rows only those below twice the share that is wanted are sorted, so that a task never
    gets more than a few times ``n`` of them, however many partitions there are. Equal values count once.
    """
    hashes = rows.select(order)
    total = hashes.count()
    some = hashes
    if total > 4 * n:
        below = hashes.where(F.col(order) <= F.lit(int(-(2.0**63) + 2.0**64 * (2 * n + 100) / total))).distinct()
        some = below if below.count() >= n else hashes.distinct()  # many repeated rows
    return some.distinct().orderBy(order).limit(n).agg(F.max(order)).first()[0]


def discard(*tables: DataFrame) -> None:
    """Removes tables that ``written`` made, once all that was derived from them is written itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def ready(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever the driver was started."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
