"""Shared storage, bounded batches and connected components for the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, as in tests, a local master gets a local folder; on a cluster it raises."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/citelens-shared"
    # With its scheme, so that Spark and the tasks that open files themselves mean one place.
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Bytes of a batch that goes to a Python worker in an operator's own actions.
BATCH, BATCH_SETTING = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession):
    """Batches of BATCH bytes at most for the actions inside; the caller's setting is back afterwards."""
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, BATCH)
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it again."""
    path = new_folder(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.option("compression", codec).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def forget(*tables: DataFrame) -> None:
    """Delete tables made by written() whose readers have all been written themselves."""
    for table_ in tables:
        spark = table_.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table_.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def opened(folder: str):
    """The file system of a folder and its path there; any that executors can reach, not only local ones."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, each with underscores added until df has no column of it in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def bounded(batches, rows: int = 500):
    """Arrow batches in parts of so many rows. Spark bounds a batch by bytes (64 MB unless set), this what becomes Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Bits of a filter for each key, and at most: beyond, more rows pass it than need to.
BITS, MOST_BITS = 12, 1 << 28


def filter_of(hashes: DataFrame):
    """A test for a column of 64-bit hashes: false where it is certainly not among hashes (one column), true where it may be.

    A Bloom filter with three bits a key, built in the cluster; the driver gets and broadcasts its bits, 32 MB at most."""
    spark = hashes.sparkSession
    size = 1 << 16
    count = hashes.count()
    while size < min(MOST_BITS, BITS * count):
        size *= 2
    spots = lambda h: [F.pmod(F.xxhash64(h, F.lit(i)), F.lit(size)) for i in range(3)]
    place = hashes.select(F.explode(F.array(*spots(F.col(hashes.columns[0])))).alias("at")).select((F.col("at") + 1).alias("at"))
    maps = place.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    filled = np.zeros(size // 8, dtype=np.uint8)
    for row in maps.toLocalIterator():
        own = np.frombuffer(row.bits, dtype=np.uint8)
        at = (row.bucket - 1) * len(own)
        filled[at : at + len(own)] |= own[: len(filled) - at]
    held = spark.sparkContext.broadcast(filled)

    @F.pandas_udf("boolean")
    def met(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        hit = [(held.value[x.to_numpy() >> 3] >> (x.to_numpy() & 7).astype(np.uint8)) & 1 for x in (a, b, c)]
        return pd.Series((hit[0] & hit[1] & hit[2]).astype(bool))

    return lambda h: met(*spots(h))


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components", most: int = 60) -> DataFrame:
    """Columns node, root of every node that has an edge; root is the least node of its component.

    Alternating large-star and small-star rounds; each is written to the shared folder, nothing but two
    numbers per round reaches the driver. Nulls and loops are dropped; without edges the result is empty."""
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    pairs, last = written(pairs, name), None
    for _ in range(most):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        before, pairs = pairs, written(small, name)
        forget(before)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    stars = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select("root", "root").distinct().toDF("node", "root"))
