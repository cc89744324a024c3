"""Helpers of the training-data operators: tables, cutting lineage, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS_PER_TASK = 250_000
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 20_000_000  # of rows with fixed-size columns (100 bytes at most), and of their text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _checkpoint_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a local session (tests) may go without and gets a temporary folder."""
    context = spark.sparkContext
    now = context._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (None if now.isEmpty() else now.get())
    if folder is None:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="critiq-checkpoint-")
    if now.isEmpty():
        context.setCheckpointDir(folder)
    return folder


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name beneath the shared checkpoint folder."""
    return f"{_checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder and read back; survives lost executors."""
    _checkpoint_root(df.sparkSession)
    return df.checkpoint()


def lean_batches(df: DataFrame) -> DataFrame:
    """df, whose texts are about to go through Python: its session then makes Arrow batches of BATCH_ROWS rows, unless
    a number of rows is set for it. A batch is held on both sides of the worker's pipe, there and back."""
    conf = df.sparkSession.conf
    if BATCH_SETTING not in conf.getAll:
        conf.set(BATCH_SETTING, BATCH_ROWS)
    return df


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores appended until no column of df is called so (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def few(df: DataFrame, text: str) -> DataFrame:
    """df, marked for a broadcast if it has BROADCAST_ROWS rows at most and BROADCAST_BYTES in ``text``, its only column
    without a fixed size."""
    rows, size = df.agg(F.count("*"), F.sum(F.octet_length(F.col(text).cast("string")))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else df


def ranked(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """df, and two columns: ``_rank``, the position (from 0) of a row among its group's by ``order``, and ``_rows``, the group's size.

    No group meets in one task: the rows are range-partitioned by group and order and written sorted to the shared
    folder; a group's rank continues from one partition to the next by the counts of (partition, group), one small
    row each. Rows that ``order`` cannot tell apart must be alike: which of them comes first is open. Null groups are a
    group. ``order`` may rank nulls as it likes.
    """
    keys = [F.col(group).asc_nulls_first(), *order]
    rows = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys)).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    runs = rows.groupBy("_part", F.col(group).alias("_group")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy("_group")
    before = F.sum("_n").over(whole.orderBy("_part")) - F.col("_n")
    runs = cut(runs.select(F.col("_part").alias("_run_part"), "_group", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("_rows")))
    here = (F.col("_part") == F.col("_run_part")) & F.col(group).eqNullSafe(F.col("_group"))
    return rows.join(few(runs, "_group"), here).select(*df.columns, (F.col("_at") + F.col("_shift")).alias("_rank"), "_rows")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every vertex of ``edges`` (columns a, b): component is the least id reachable.

    Alternating large and small stars: each round links every neighbour of a vertex to the least
    one, by a minimum per vertex (combined before the shuffle, so a hub costs one row per task)
    and a join back (split by adaptive execution when a hub is hot), until every vertex has one
    link and leads to a vertex without any. The number of rounds grows with the logarithm of the
    longest path; each is cut in the shared folder. Loops and repeated edges are harmless; rows
    with a null end are ignored.
    """

    def least(arcs: DataFrame) -> DataFrame:
        return arcs.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))

    def packed(df: DataFrame) -> DataFrame:
        df = cut(df.filter("a != b").distinct())
        return df.coalesce(1 + df.count() // ROWS_PER_TASK)  # links are narrow rows

    now = packed(edges.select("a", "b"))
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(least(both), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = least(large)
        down = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = packed(down.unionByName(small.select("a", F.col("m").alias("b"))))
        firsts = now.groupBy("a").agg(F.count("*").alias("c"))
        open_ends = now.select("b").join(firsts.select("a"), F.col("b") == F.col("a"), "left_semi").select("b").unionByName(firsts.filter("c > 1").select(F.col("a").alias("b")))
        if not open_ends.limit(1).count():
            break
    roots = now.select(F.col("b").alias("a")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots.select(F.col("a").alias("id"), F.col("a").alias("component")))
