"""Splits, ranks, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelens.storage import written


def greedy_split(contexts: DataFrame, cited: str, citing: str, share: float = 0.8) -> DataFrame:
    """cited, citing, n, is_test. Citing documents of a cited one go by contexts, most first, least id on ties; they are
    train until the train contexts are more than share of all, and the last is always test. Cited documents with one citing document go."""
    counts = contexts.groupBy(cited, citing).agg(F.count("*").alias("n"))
    order = Window.partitionBy(cited).orderBy(F.desc("n"), citing)
    whole = Window.partitionBy(cited)
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.select(cited, citing, "n", before.alias("__before"), F.sum("n").over(whole).alias("__all"), F.row_number().over(order).alias("__rn"), F.count("*").over(whole).alias("__m"))
    test = (F.col("__before") > F.floor(F.col("__all") * share)) | (F.col("__rn") == F.col("__m"))
    return placed.where("__m >= 2").select(cited, citing, "n", test.alias("is_test"))


def ranked(scores: DataFrame, query: str, score: Column, tie: str, most: int | None = None) -> DataFrame:
    """scores with rank from 1; a limit is pushed below the sort by Spark's window group limit."""
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(score.desc(), F.col(tie))))
    return out.where(F.col("rank") <= most) if most else out


def reranked_first(ranking: DataFrame, query: str, item: str) -> DataFrame:
    """Each item at its best place, places closed up."""
    best = ranking.groupBy(query, item).agg(F.min("rank").alias("first"))
    return best.select(query, item, F.row_number().over(Window.partitionBy(query).orderBy("first")).alias("rank"))


def stratified(rows: DataFrame, strata: list[str], share: float, order: Column) -> DataFrame:
    """The first rows of each stratum by a given order, half-even rounded share of its size."""
    w = Window.partitionBy(*strata)
    placed = rows.withColumn("__n", F.count("*").over(w)).withColumn("__rn", F.row_number().over(w.orderBy(order)))
    return placed.where(F.col("__rn") <= F.bround(F.col("__n") * share, 0)).drop("__n", "__rn")


def numbered(rows: DataFrame, *order, name: str = "number") -> tuple[DataFrame, int]:
    """rows with number (0, 1, ...) by an order, and their count.

    Rows are dealt out by ranges of the order and written; each range's rows are numbered where they are, and a row per range
    with the sum of those before it is all that meets in one place."""
    at = F.monotonically_increasing_id()
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", at), "numbered")
    placed = placed.withColumn("__range", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND((1 << 33) - 1))
    sizes = placed.groupBy("__range").agg(F.count("*").alias("__size"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__range", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    out = placed.join(F.broadcast(starts), "__range").withColumn(name, F.col("__start") + F.col("__at"))
    return out.drop("__range", "__at", "__start"), placed.count()
