"""Helpers shared by the training-data operators: shared-folder staging, row keys, components."""

from __future__ import annotations

import atexit
import ctypes
import sys
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's checkpoint dir; a temporary one only where all run in this process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="veilspark-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/veilspark-{spark.sparkContext.applicationId}"


class _Folder:
    """A folder on any of Hadoop's file systems; it can be deleted after the session has stopped, too."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.system = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def delete(self) -> None:
        self.system.delete(self.path, True)


_folders: dict[str, _Folder] = {}
#: Staged tables that are still there, by path, in the order they were made.
staged: dict[str, SparkSession] = {}


def _sweep(root: str) -> None:
    """At the driver's end: what is still staged goes, unless the JVM has gone before."""
    try:
        _folders.pop(root).delete()
    except (Py4JError, OSError):
        print(f"{root} could not be deleted: the JVM has ended", file=sys.stderr)


#: Setting under which Spark drops an execution's shuffle files as it ends.
DROPS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    What the write has shuffled goes with its end; no other plan reads it, and else it stays until the driver's JVM happens to collect its garbage.
    """
    spark = df.sparkSession
    root = shared_dir(spark)
    if root not in _folders:
        _folders[root] = _Folder(spark, root)
        atexit.register(_sweep, root)
    path = f"{root}/{uuid.uuid4().hex}"
    before = spark.conf.get(DROPS, None)
    spark.conf.set(DROPS, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(DROPS) if before is None else spark.conf.set(DROPS, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    staged[path] = spark
    return out


def unstage(*frames: DataFrame) -> None:
    """Drop staged tables that no later plan reads."""
    for df in frames:
        if path := getattr(df, "_staged_path", None):
            free(path)


def free(path: str) -> None:
    if spark := staged.pop(path, None):
        _Folder(spark, path).delete()


def give_back(spark: SparkSession) -> str:
    """Return to the system what the allocators of the driver's Python and JVM hold free; what the JVM says of it, or nothing where it can't.

    Compiled plans, task messages and a fitted model leave free blocks that glibc keeps, so a driver of many plans grows.
    """
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        types, given = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
        for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            types[i] = jvm.java.lang.Class.forName(name)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # the server's class isn't public: only by the interface can the method be called
        return jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", types).invoke(server, given)
    except Py4JError:  # another JVM, or one before 17.0.9
        return ""


def slices(parts: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of ``rows`` rows, so that what Python holds of a batch at once stays small."""
    for part in parts:
        for begin in range(0, part.num_rows, rows):
            yield part.slice(begin, rows)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def text_key(text: Column) -> Column:
    """128-bit key of a text as 16 bytes; a null text counts as the empty one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def row_key(columns: list[str]) -> Column:
    """128-bit key of a whole row; rows share it only if all their columns are equal."""
    parts = [F.coalesce(F.md5(F.col(f"`{c}`").cast("string").cast("binary")), F.lit("-")) for c in columns]
    return F.unhex(F.md5(F.concat_ws(",", *parts).cast("binary")))


def kept(keep: list[str], new: list[str]) -> tuple[list[str], list[Column]]:
    """Names to keep and their columns, whatever signs the names hold; those that a result names itself are replaced by it."""
    names = [c for c in keep if c not in new]
    return names, [F.col(f"`{c.replace('`', '``')}`") for c in names]


def fed(docs: DataFrame, columns: list[Column]) -> DataFrame:
    """The columns and the text behind them, under plain names, as a map over Arrow batches takes no others."""
    return docs.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)], F.col("text").alias("text"))


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` doesn't use yet."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    ``edges`` has two columns ``a`` and ``b`` of one orderable type. Returns (node, root) for every
    node of an edge, root being the least node of its component. Each step is a map-side combined
    minimum and an equi-join that AQE can split at a hot star centre; nothing is collected but
    whether all edges form stars, which ends the rounds. Null ends and self loops are ignored; an
    empty input gives an empty result.
    """
    e = stage(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )

    def settled(df: DataFrame) -> bool:
        """True if each node has one edge down at most, and none that is at the lower end of one has."""
        ends = df.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("low"))
        ends = ends.union(df.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("low")))
        by = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("low").alias("low"))
        return by.where((F.col("down") > 1) | ((F.col("down") == 1) & (F.col("low") == 1))).isEmpty()

    rounds = 0
    while not settled(e):
        rounds += 1
        if rounds > most_rounds:
            raise RuntimeError("components did not settle")
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
        large = (
            both.where(F.col("b") > F.col("a")).join(low, F.col("a") == F.col("c"))
            .select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()
        )
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "c")
        joined = large.join(low, F.col("a") == F.col("c")).select("a", "b", "m")
        small = (
            joined.select("a", F.col("m").alias("b"))
            .union(joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")))
            .distinct()
        )
        new = stage(small)
        unstage(e)
        e = new
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def ordered_index(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Gapless 0-based position in a global order, without a one-task window.

    Rows are range-partitioned and staged, numbered inside each range, and shifted by the counts of
    the ranges before (one row a partition).
    """
    from pyspark.sql import Window

    pid, base = free_name(df, "__range"), free_name(df, "__base")
    spread = stage(df.repartitionByRange(*order).withColumn(pid, F.spark_partition_id()))
    before = Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    counts = spread.groupBy(pid).count().select(pid, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(base))
    return (
        spread.withColumn(name, F.row_number().over(Window.partitionBy(pid).orderBy(*order)) - 1)
        .join(F.broadcast(counts), pid)
        .withColumn(name, (F.col(name) + F.col(base)).cast("long"))
        .drop(pid, base)
    )
