"""Tables in the shared folder, and components of links held in them."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Our own folder, made where the session names none.
_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; one of our own only where that is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="millrace-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        folder = _OWN[0]
    return folder


#: Documents are long: so many rows to an Arrow batch, unless the session says otherwise.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """A worker holds a batch of whole texts at a time; the default of 10,000 rows is for short rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving the memory back that it has used: workers live on after their task, and an executor has several."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


#: Spark then removes a query's shuffle files as soon as the query has ended.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read again: lineage is cut, and a lost executor costs no recomputation.

    The shuffles that made it are of no more use and their files go at once, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the files of a frame that stored() returned and nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _starred(edges: DataFrame) -> DataFrame:
    """edges (a, b), a > b: of every a its smallest b, and the other bs joined to that one. Same components, repeats gone."""
    least = edges.groupBy("a").agg(F.min("b").alias("_least"))
    other = edges.join(least, "a").where("b > _least").select(F.col("b").alias("a"), F.col("_least").alias("b"))
    return least.select("a", F.col("_least").alias("b")).union(other.distinct())


def components(edges: DataFrame, what: str) -> DataFrame:
    """(node, component) of every node in edges (a, b): component is the smallest node reachable.

    Large stars and small stars in turn: an edge to a node goes on to that node's smallest neighbour, then every node keeps
    its smallest neighbour and hands the others to it, until all edges are stars. Edges come from tasks' forests, so a node has
    one edge for each task that saw it; those are brought together by an aggregate before anything is joined. Edges live
    in stored tables; nothing but a count and a checksum comes to the driver.
    """
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    met = down.groupBy("a").agg(F.min("b").alias("b"), F.collect_set("b").alias("_all"))  # as many as tasks saw it, at most
    met = stored(met, f"{what}-edges")
    handed = met.where("size(_all) > 1").select(F.explode(F.array_remove("_all", F.col("b"))).alias("a"), "b").distinct()
    now = stored(met.select("a", "b").union(handed), f"{what}-edges")
    discard(met)
    state = None
    while True:
        reached = now.agg(F.count(F.lit(1)), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if reached == state:
            break
        state = reached
        up = now.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("_b"))
        large = stored(now.join(up, now.b == up._a, "left").select("a", F.coalesce("_b", "b").alias("b")), f"{what}-edges")
        small = stored(_starred(large), f"{what}-edges")
        discard(now)
        discard(large)
        now = small
    labels = stored(now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct()), f"{what}-labels")
    discard(now)
    return labels


class Forest:
    """Union-find over the nodes that a task has met."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, i: int) -> int:
        up = self.up
        above = up.setdefault(i, i)
        while above != i:
            up[i] = up[above]
            i = up[i]
            above = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """True if i and j were apart until now."""
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True
