"""What several operators of this package share."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: U+0020 and U+0009 to U+000D, as a class for Java and RE2.
WHITE = r"\x20\x09-\x0D"

#: Rows of an Arrow batch while a table is written: texts are long, and both sides hold a batch whole.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000

_OWN: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the folder, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor see: spark.checkpoint.dir.

    Where a session on one machine names none (tests) a temporary one is set. On a cluster
    no folder of this machine would be seen by the executors, so there it must be set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        if "own" not in _OWN:
            _OWN["own"] = tempfile.mkdtemp(prefix="docstrata-")
            spark.sparkContext.setCheckpointDir(_OWN["own"])
        folder = _OWN["own"]
    return folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    This cuts the lineage, survives lost executors and keeps a computation that
    two consumers need from running twice. The table goes with discard, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    rows = spark.conf.get(BATCH, "10000")
    spark.conf.set(BATCH, str(min(int(rows), BATCH_ROWS) if int(rows) > 0 else BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH, rows)
    atexit.register(_remove, spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table.shared_path_ = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables of materialize that nothing lazy reads any more."""
    for table in tables:
        _remove(table.sparkSession, table.shared_path_)


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release_memory() -> None:
    """Hand freed memory back to the system.

    A Python worker outlives its task, and several may wait beside the JVM for the next stage;
    what their allocators keep would count against the executor.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of Linux has it
    if trim is not None:
        trim(0)


def text_of(column: str = "text") -> Column:
    """The text, null taken as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def fingerprint(column: Column) -> tuple[Column, Column]:
    """Two independently seeded 64-bit hashes: 128 bits that identify a string."""
    return F.xxhash64(column), F.xxhash64(F.lit("second"), column)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b), component being its smallest node.

    Alternates large-star and small-star steps until every node points straight at its root.
    Minima are taken by a grouped aggregate and joined back, so that a node of very
    high degree is combined on the map side and split by AQE's skew join rather than
    gathered in one task. Edges stay distributed; each step is a written table.
    """
    a, b = F.col("a"), F.col("b")
    forest = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(a > b).distinct()
    forest = materialize(forest, "edges")
    while not _is_star_forest(forest):
        both = forest.unionByName(forest.select(b.alias("a"), a.alias("b")))
        low = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "low")
        large = both.where(b > a).join(low, "a").select(b.alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large")
        lower = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        pointed = large.join(lower, "a")
        small = pointed.where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        shorter = materialize(small.unionByName(lower.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(forest, low, large, lower)
        forest = shorter
    roots = forest.select(b.alias("node"), b.alias("component")).distinct()
    return forest.select(a.alias("node"), b.alias("component")).unionByName(roots)


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every node points straight at one root, which points nowhere."""
    several = edges.groupBy("a").agg(F.count("*").alias("n")).where("n > 1")
    if not several.isEmpty():
        return False
    inner = edges.join(edges.select(F.col("b").alias("root")).distinct(), F.col("a") == F.col("root"), "left_semi")
    return inner.isEmpty()
