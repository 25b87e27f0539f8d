"""Counts, histograms, frequencies, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shares(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, share of all rows."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def count_of_counts(rows: DataFrame, key: str) -> DataFrame:
    """size, n: how many keys occur so often."""
    return rows.groupBy(key).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


def histogram(rows: DataFrame, value: Column, lo: float, hi: float, bins: int) -> DataFrame:
    """bin (0 ..), n, share. The right edge belongs to the last bin; values outside are left out."""
    b = F.least(F.floor((value - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    n = rows.where((value >= lo) & (value <= hi)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def grid(rows: DataFrame, x: Column, y: Column, xs: tuple[float, float, int], ys: tuple[float, float, int]) -> DataFrame:
    """bx, by, n in a grid of equal cells."""
    cell = lambda v, lo, hi, k: F.least(F.floor((v - lo) / ((hi - lo) / k)), F.lit(k - 1)).cast("int")
    inside = rows.where((x >= xs[0]) & (x <= xs[1]) & (y >= ys[0]) & (y <= ys[1]))
    return inside.groupBy(cell(x, *xs).alias("bx"), cell(y, *ys).alias("by")).agg(F.count("*").alias("n"))


def term_statistics(terms: DataFrame, doc: str = "doc", term: str = "term") -> DataFrame:
    """term, cf, df, in two steps so that a common term is summed up before the shuffle."""
    return terms.groupBy(doc, term).agg(F.count("*").alias("__tf")).groupBy(term).agg(F.sum("__tf").alias("cf"), F.count("*").alias("df"))


def agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """same, different, observed, alpha (Krippendorff, nominal, two raters) of a table with a rating of each per item."""
    both = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = both.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("n"))
    split = cells.agg(F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"), F.sum(F.when(F.col("x") != F.col("y"), F.col("n")).otherwise(0)).alias("different"))
    marks = cells.select(F.col("x").alias("c"), "n").unionByName(cells.select(F.col("y").alias("c"), "n")).groupBy("c").agg(F.sum("n").alias("m"))
    expected = marks.agg(F.sum("m").alias("total"), F.sum(F.col("m") * F.col("m")).alias("squares"))
    r = split.crossJoin(expected)  # one row each
    total = F.col("total").cast("double")
    alpha = 1 - (total - 1) * (2.0 * F.col("different")) / (total * total - F.col("squares"))
    return r.select("same", "different", (F.col("same") / (F.col("same") + F.col("different"))).alias("observed"), alpha.alias("alpha"))


def conditional_probability(all_counts: DataFrame, own_counts: DataFrame, least: int) -> DataFrame:
    """pattern, p: own / all for patterns counted so often that do not begin with the end mark."""
    kept = all_counts.where((F.col("n") >= least) & ~F.col("pattern").startswith("<EOS>¦"))
    return kept.join(own_counts.withColumnRenamed("n", "own"), "pattern").select("pattern", (F.col("own") / F.col("n")).alias("p"))
