"""What the operators share: intermediate tables, components of links, word patterns."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch at most. JVM and Python each hold a batch of texts more than once, and the default is 10,000.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's rows an Arrow batch to BATCH_ROWS, if it has more."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, as in tests, a temporary one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Paths that new_path() gave and that weren't removed yet.
_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's Python ends, or by clear()."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    atexit.register(remove, spark, path)
    return path


def made() -> int:
    """A mark for clear()."""
    return len(_made)


def clear(spark: SparkSession, mark: int, *keep: str) -> None:
    """Deletes the tables made since the mark, but for those to keep: for a driver that goes on for long."""
    for path in [p for p in _made[mark:] if p not in keep]:
        _made.remove(path)
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path in the shared folder; at the driver's end the JVM may be gone already."""
    context = spark.sparkContext
    if context._jsc is None:
        return
    try:
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
    except (OSError, AttributeError, ConnectionError):
        return


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: later steps neither compute it again nor lose it with an executor."""
    return staged_at(df, name)[0]


def staged_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As staged(), with the table's path, for remove()."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of links (a long, b long): (node, root) for every linked node, root being the smallest.

    Large-star and small-star rounds (Kiveris et al., 2014), each written to the shared folder. Only aggregates with
    partial sums and joins that Spark can split see a hub; nothing is gathered by node.
    """
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, path = staged_at(pairs, "links")
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after, new = staged_at(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        remove(edges.sparkSession, path)
        edges, path = after, new
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor("v")).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError(f"no fixed point in {most_rounds} rounds")
