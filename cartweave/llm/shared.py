"""What the operators share: tables, the folder that all executors see, and connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bounded_batches(spark: SparkSession) -> None:
    """Batches that go to Python are bounded in bytes too, as texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset (tests on one machine) a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not where:
        where = context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(where)
    elif not context.getCheckpointDir():
        context.setCheckpointDir(where)
    return where


#: Files that ``few`` leaves: so many for each core, or one for so many shuffle partitions if that is more.
FILES_PER_CORE, PARTITIONS_PER_FILE = 4, 8


def few(frame: DataFrame) -> DataFrame:
    """The same rows in fewer partitions, without a shuffle; for steps that don't go by the number of their partition.

    For each file that is written Hadoop starts two processes (chmod of the file and of its checksums) where it has no native library, and until
    such a process has its own image it counts as a second copy of the executor. The number of partitions follows that of a shuffle, so that tasks don't grow with the data.
    """
    spark = frame.sparkSession
    return frame.coalesce(max(FILES_PER_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // PARTITIONS_PER_FILE))


def swept(spark: SparkSession) -> None:
    """Shuffle files of plans that are no longer needed are deleted when the driver collects its garbage, which a driver with memory
    to spare puts off for long; so it is asked to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(frame: DataFrame) -> DataFrame:
    """The same rows from reliable storage; executors that are lost later don't matter."""
    shared_dir(frame.sparkSession)
    out = frame.checkpoint(eager=True)
    swept(frame.sparkSession)
    return out


def returning(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """run, after which the worker gives freed memory back.

    Workers live on for later stages, and Arrow and the C library would keep the most that any stage took.
    """

    def wrapped(batches):
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
        if trim:
            trim(0)

    return wrapped


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts: what numbers of tasks follow."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def named(c: str) -> Column:
    """The column of just this name, whatever characters are in it."""
    return F.col("`" + c.replace("`", "``") + "`")


def set_apart(docs: DataFrame, *own: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """(docs with the columns ``own`` and all others in one, a function that gives a frame the columns of docs again, and others that are named).

    Names that an operator uses for columns of its own so can't clash with those of docs.
    """
    columns = docs.columns
    others = [c for c in columns if c not in own]
    kept = [named(c) for c in own if c in columns]
    if others:
        kept.append(F.struct(*map(named, others)).alias("__others"))
    back = [named(c) if c in own else F.col("__others").getField(c).alias(c) for c in columns]
    return docs.select(*kept), lambda frame, *more: frame.select(*back, *more)


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing needs any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id in edges (a, b): root is the smallest id that can be reached.

    Alternates large-star and small-star steps; both only need the smallest neighbour of each node, which is summed on the map
    side, so a hub with millions of links is no hot key. Ends when a round changes nothing.
    """
    state = cut(few(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()))
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(state)
    while before[0]:
        both = state.union(state.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).where("u <> v").distinct()
        state = cut(few(small))
        after = mark(state)
        if after == before:
            break
        before = after
    return state.select(F.col("u").alias("id"), F.col("v").alias("root")).union(state.select("v", "v").distinct())
