"""Tables written once in the shared folder: they cut lineage, have known sizes, and fix what is read twice."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; where unset (tests), one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return _OWN[app]


def delete_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the session ends."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once as a table in the shared folder and read back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation, and the sizes
    of the files replace Spark's guesses in later joins. The folder goes when the session ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def forget(df: DataFrame) -> None:
    """Drop a table made by ``written`` that no later step reads."""
    path = getattr(df, "scratch_path", None)
    if path:
        delete_path(df.sparkSession, path)


#: Written tables of up to so many bytes on disk, and rows, may be broadcast; beyond, both sides are shuffled.
BROADCAST_BYTES, BROADCAST_ROWS = 24 << 20, 1_000_000


def hinted(df: DataFrame) -> DataFrame:
    """A table made by ``written``, with the join hint that its measured size allows."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return df.hint("broadcast" if size <= BROADCAST_BYTES and df.count() <= BROADCAST_ROWS else "merge")


#: Files of so many bytes make one task of ``tasks_of``.
TASK_BYTES = 8 << 20


def tasks_of(*dfs: DataFrame) -> int:
    """Tasks enough for all rows of these tables, by the sizes of the files they are read from: their number grows with the input, what one of them sorts does not."""
    spark = dfs[0].sparkSession
    conf, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(x)) for x in {x for df in dfs for x in df.inputFiles()}]
    size = sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)
    return max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))


def placed(df: DataFrame, name: str = "place", offset: int = 1) -> DataFrame:
    """Rows with their place, from ``offset`` on without gaps, in the order of the partitions of ``df`` and of the rows within each.

    The rows and their places within their partition are written first, so both the counts and the rows are those of one evaluation: evaluated
    twice, a partition need not hold the same rows. Each partition then adds the rows of those before it; no task sees all rows.
    """
    held = [c for c in df.columns if c != name]
    rows = written(df.select(F.struct(*[F.col(f"`{c}`") for c in held]).alias("row"), F.monotonically_increasing_id().alias("at")), "placed")
    part = F.shiftright("at", 33).alias("part")
    sizes = rows.groupBy(part).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row per partition that held any.
    met = rows.select("row", part, F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("within")).join(F.broadcast(sizes.select("part", before.alias("before"))), "part")
    return met.select("row.*", (F.col("before") + F.col("within") + offset).alias(name))
