"""Joins that the pipeline is made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], window: tuple[str, str], span: tuple[str, str], cell=None) -> DataFrame:
    """Pairs with equal keys whose span meets the window, ends included.

    The keys make it an equi join, the range is tested inside. Where a key may have very many rows, cell gives the whole number of the cell that
    a bound falls in: both sides are then dealt out to the cells that they reach into, so that only rows of one cell meet, each pair in the first cell that both have."""
    r = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    both = (F.col(span[0]) <= F.col(window[1])) & (F.col(span[1]) >= F.col(window[0]))
    for k in keys:
        both = both & (F.col(k) == F.col(f"__{k}"))
    helpers = [f"__{k}" for k in keys]
    if cell is not None:
        cells = lambda df, ends, at, first: df.withColumn(first, cell(F.col(ends[0]))).withColumn(at, F.explode(F.sequence(F.col(first), cell(F.col(ends[1])))))
        left, r = cells(left, window, "__lc", "__lf"), cells(r, span, "__rc", "__rf")
        both = both & (F.col("__lc") == F.col("__rc")) & (F.col("__lc") == F.greatest("__lf", "__rf"))
        helpers += ["__lc", "__lf", "__rc", "__rf"]
    return left.join(r, both).drop(*helpers)


def preceding_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, end: str, within) -> DataFrame:
    """Pairs with equal keys where the right row ends before the left one, by no more than within."""
    r = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    both = (F.col(at) - F.col(end) > 0) & (F.col(at) - F.col(end) <= within)
    for k in keys:
        both = both & (F.col(k) == F.col(f"__{k}"))
    return left.join(r, both).drop(*[f"__{k}" for k in keys])


def nearest_before(rows: DataFrame, keys: list[str], at: str, value: str, within) -> DataFrame:
    """rows with value_before: the value of the nearest row of equal keys that stands before by no more than within, the greatest of several at one place. One pass by a window over ranges of the place."""
    near = Window.partitionBy(*keys).orderBy(at).rangeBetween(-within, -1)
    return rows.withColumn(f"{value}_before", F.max(F.struct(at, value)).over(near)[value])


def best_candidate(found: DataFrame, keys: list[str], best: list) -> DataFrame:
    """The first row of each key in an order that has no ties left."""
    return found.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).where("__rn = 1").drop("__rn")


#: Rows of a block of equal_pairs(), and pairs that a task makes of them.
PAIR_BLOCK, PAIRS = 1_000, 8_000_000


def equal_pairs(rows: DataFrame, key: str) -> DataFrame:
    """a, b of all pairs of rows (key, id) with equal keys and a < b.

    There are as many as the keys' squares, so the work is dealt out: a key's ids fall into blocks by hash, pairs of blocks are rows that any task can take,
    and each pair of ids is made in the one pair of blocks that has it, without a sort or a buffer of a key's rows."""
    rows = rows.where(F.col(key).isNotNull() & F.col("id").isNotNull())
    sizes = rows.groupBy(key).agg(F.count("*").alias("__n"))
    parts = sizes.agg(F.sum(F.col("__n").cast("double") * F.col("__n")) / 2).first()[0] or 0
    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("__n") / PAIR_BLOCK)).cast("int")
    blocks = rows.join(sizes, key).select(key, block.alias("__i"), "id").groupBy(key, "__i").agg(F.collect_list("id").alias("__a"))
    both = blocks.join(blocks.select(key, F.col("__i").alias("__j"), F.col("__a").alias("__b")), key).where("__i <= __j")
    both = both.select("__i", "__j", "__a", "__b").repartition(max(1, int(parts / PAIRS) + 1))
    each = both.select("__i", "__j", "__b", F.explode("__a").alias("__x")).select("__i", "__j", "__x", F.explode("__b").alias("__y"))
    return each.where("__x < __y OR __i < __j AND __x > __y").select(F.least("__x", "__y").alias("a"), F.greatest("__x", "__y").alias("b"))


def contained_titles(references: DataFrame, titles: DataFrame, ref_key: str, title_key: str) -> DataFrame:
    """ref_key, title_key of each cleaned title that a cleaned reference contains.

    Pairs come from a shared word, not from a cross join: a title's rarest word, cut at the title's ends where other
    letters could touch it, has to be inside the reference's words. A title of one or two words can begin and end inside
    other words, so its rarest three letters in a row have to be among the reference's; one of one or two letters is
    itself among the reference's rows of so many letters."""
    words = references.select(ref_key, F.explode(F.array_distinct(F.split("reference", " "))).alias("word"))
    df = words.groupBy("word").agg(F.count("*").alias("df"))
    t = titles.where("title <> ''").withColumn("__w", F.split("title", " "))
    inner = t.where(F.size("__w") > 2).select(title_key, "title", F.explode(F.array_distinct(F.slice("__w", 2, F.greatest(F.size("__w") - 2, F.lit(1))))).alias("word"))
    rare = best_candidate(inner.join(df, "word"), [title_key], [F.col("df"), F.col("word")]).select(title_key, "title", "word")
    pairs = words.join(rare, "word").select(ref_key, title_key, "title").join(references, ref_key)
    found = pairs.where(F.contains("reference", "title")).select(ref_key, title_key)
    short = t.where(F.size("__w") <= 2).select(title_key, "title", F.least(F.length("title"), F.lit(3)).alias("n"))
    sizes = F.sequence(F.lit(1), F.lit(3))
    held = references.select(ref_key, F.explode(F.array_distinct(F.flatten(F.transform(sizes, lambda n: pieces(F.col("reference"), n))))).alias("piece"))
    parts = short.select(title_key, "title", F.explode(F.array_distinct(pieces(F.col("title"), F.col("n")))).alias("piece"))
    wanted = parts.select("piece").distinct()
    held = held.join(wanted, "piece", "left_semi")
    piece_df = held.groupBy("piece").agg(F.count("*").alias("df"))
    # A title with a piece that no reference has is in none of them; a left join keeps its zero, which is then the rarest.
    rarest = best_candidate(parts.join(piece_df, "piece", "left").withColumn("df", F.coalesce("df", F.lit(0))), [title_key], [F.col("df"), F.col("piece")]).select(title_key, "title", "piece")
    few = held.join(rarest, "piece").select(ref_key, title_key, "title").join(references, ref_key)
    return found.unionByName(few.where(F.contains("reference", "title")).select(ref_key, title_key))


def pieces(text, n):
    """All runs of n letters of a text; none if it is shorter."""
    n = F.lit(n) if isinstance(n, int) else n
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(text, i, n))


def without_done(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def with_at_least(rows: DataFrame, key: str, least: int) -> DataFrame:
    """Rows whose key occurs so often."""
    often = rows.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select(key)
    return rows.join(often, key, "left_semi")


def looked_up(rows: DataFrame, dimension: DataFrame, key: str, value: str, other: str = "other") -> DataFrame:
    """rows with value from the dimension, or other where it has none."""
    return rows.join(dimension.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(other)))
