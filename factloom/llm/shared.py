"""What the operators share: tables that cut lineage, joins that stand hot keys, components of a graph."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary one, but only on a local master, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def settled(df: DataFrame) -> DataFrame:
    """``df`` in fewer, larger files than the shuffle has partitions: a sixth of them, or three tasks a core if that is more.

    A core has three tasks in turn at least, so that none idles long, and a task
    takes its partitions one after another, in the memory of one. The number of
    shuffle partitions follows the data, and so do the files.
    """
    spark = df.sparkSession
    return df.coalesce(max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 6))


class Tables:
    """Tables of one run of an operator, written as Parquet in the shared folder.

    A written table cuts lineage and survives lost executors; the shuffle files
    of the job that wrote it are freed when the job ends, so that an operator of
    several steps needs the disk of its largest step.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame, settle: bool = True) -> DataFrame:
        """``df`` as a table, ``settled`` unless its partitions matter. Executors collect before the first: their heaps are as large as what ran before left them."""
        if not self.count:
            rested(self.spark)
        path = f"{self.folder}/{self.count}"
        self.count += 1
        before = self.spark.conf.get(CLEANUP, None)
        with contextlib.suppress(Exception):  # older sessions don't have the setting
            self.spark.conf.set(CLEANUP, "true")
        try:
            (settled(df) if settle else df).write.parquet(path)
        finally:
            with contextlib.suppress(Exception):
                self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        if self.count % 4 == 0:
            relieved(self.spark)
        table = self.spark.read.schema(df.schema).parquet(path)
        table.folder = path
        return table

    def drop(self, table: DataFrame) -> None:
        """Frees a table that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(table.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


_held: dict[str, object] = {}


def held(name: str, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task under a name: one thing at a time, as workers serve every stage in turn."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, whose worker gives the memory that it has freed back to the system when its task ends: workers outlive stages."""
    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # a C library without it
            ctypes.CDLL(None).malloc_trim(0)

    return freed


def trimmed(spark: SparkSession) -> str:
    """The driver's JVM runs its diagnostic command System.trim_native_heap; what it said."""
    java = spark._jvm.java.lang
    server = java.management.ManagementFactory.getPlatformMBeanServer()  # its class isn't public, so the interface's method is called
    invoke = next(m for m in java.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    said = spark.sparkContext._gateway.new_array(java.Object, 4)
    said[0], said[1] = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    return str(invoke.invoke(server, said))


def relieved(spark: SparkSession) -> None:
    """The driver gives memory that it has freed back to the system: what is left of spent jobs, their broadcasts and shuffles, and of fits.

    Jobs of some seconds fill its heap long before anything calls for a
    collection, and only a full one makes it smaller. Python lets go of spent
    plans first, as the JVM keeps what they name. What compilers, collectors and
    threads of the JVM have freed is still its own until it is told to trim.
    """
    gc.collect()
    spark._jvm.System.gc()
    with contextlib.suppress(Exception):  # a JVM without the command, which came with 17.0.9
        trimmed(spark)
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def rested(spark: SparkSession) -> None:
    """Each executor collects its garbage, and so makes its heap smaller: a task for each, as the scheduler deals tasks out evenly when all are idle."""
    executors = max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)  # the driver is among them
    spark.range(0, executors, 1, executors).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def folded(text: Column) -> Column:
    """A null counts as empty; A-Z only are lower-cased."""
    return F.translate(F.coalesce(text, F.lit("")), A_TO_Z, A_TO_Z.lower())


#: A key with over this share of the rows is hot, so there are at most 1/HOT_SHARE hot keys.
HOT_SHARE = 1 / 512


def attach(rows: DataFrame, values: DataFrame, key: str | list[str], size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``values``, which has one row for each key and its number of rows in ``size``.

    Keys with over HOT_SHARE of ``total`` rows, 512 at most by that definition,
    are broadcast; their rows aren't shuffled. All others take a shuffle join, in
    which no key has over that share.
    """
    hot = values.where(F.col(size) > F.lit(total * HOT_SHARE))
    rest = values.where(~(F.col(size) > F.lit(total * HOT_SHARE)))
    few = F.broadcast(hot)
    others = rows.join(F.broadcast(hot.select(*([key] if isinstance(key, str) else key))), key, "left_anti")
    return rows.join(few, key).unionByName(others.join(rest.hint("merge"), key))


def components(edges: DataFrame, tables: Tables, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); component: the smallest node reachable.

    Alternating large and small stars (Kiveris et al., 2014): each round moves
    the larger neighbours of a node, then the smaller, to the smallest one, until
    every node hangs on its component's smallest. No round makes more edges than
    there were; a star is a written table. Self-edges and nulls are no links. The
    neighbours of a hub aren't shuffled to one task: see ``attach``.
    """
    def hung(pairs: DataFrame, least: Column, count: int) -> DataFrame:
        return attach(pairs, pairs.groupBy("a").agg(least.alias("least"), F.count("*").alias("degree")), "a", "degree", count)

    def stars(pairs: DataFrame, count: int, larger: bool) -> DataFrame:
        if larger:
            both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
            moved = hung(both, F.least(F.min("b"), F.min("a")), 2 * count)
            return moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        down = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        moved = hung(down, F.min("b"), count).where(F.col("b") != F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b"))
        return moved.unionByName(down.groupBy("a").agg(F.min("b").alias("b"))).distinct()

    def state(table: DataFrame) -> tuple:
        return tuple(table.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = tables.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = state(now)
    for _ in range(most_rounds):
        if not was[0]:
            break
        half = tables.write(stars(now, was[0], True))
        after = tables.write(stars(half, was[0], False))
        tables.drop(now)
        tables.drop(half)
        now, seen = after, state(after)
        if seen == was:
            break
        was = seen
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
