"""Mixing sources to target weights: Pareto order sampling after certain whole copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citelens.llm.shared import table, written

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST_COPIES = 1.5, 2.0
#: Ranks are cut at the target in two steps: a sum for each of so many cells of a source, then the order within the one cell where the target falls.
CELLS, STEP = 1 << 14, 1 << 7
#: Rows up to which a table of sources and size classes is broadcast.
SOURCES = 200_000
OWN = ("draw", "size", "source_size", "target", "copies", "taken", "certain", "p", "rank", "cell", "size_class", "cut_cell", "before", "rest", "extra", "upto", "g_source", "g_class", "c_source")
_WORDS = r"[^\x20\x09-\x0D]++"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """source, source_size -> with target. Weights go to the sources by code point, null last, and repeat.

    A target stops at most times its source's size; the excess is shared again by weight among the others until none
    is above. That end is one threshold t with target = min(weight * t, most * size), so it is found by running sums over
    sources ordered by most * size / weight. There is one row per source here, not per document."""
    order = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    cyclic = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", cyclic).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    rise = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").cast("binary").asc_nulls_last())
    whole = Window.partitionBy()
    before = rise.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("budget", F.sum("source_size").over(whole) * F.lit(float(share)))
    s = s.withColumn("t", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    fits = F.when(F.col("cap") >= F.col("weight") * F.col("t"), F.struct(F.row_number().over(rise).alias("at"), "t"))
    s = s.withColumn("fits", fits).withColumn("t", F.min("fits").over(whole)["t"])
    return s.select("source", "source_size", F.least("cap", F.coalesce(F.col("weight") * F.col("t"), F.col("cap"))).alias("target"))


def measure(size_class: Column) -> Column:
    """What a document of 2 ** size_class words and more weighs beside others of its source: the square root of its size, so that longer ones are likelier to be taken and to be repeated."""
    return F.pow(F.lit(2.0), size_class / 2)


def odds_of(classes: DataFrame, most: float) -> DataFrame:
    """source, size_class, due of classes (source, size_class, words, target): the copies that a document of a class is due.

    due = min(most, t * measure), with one t for each source, at which the copies' words sum up to its target. Classes are at
    the most from the heaviest downwards, so t is found by running sums over a source's classes, some forty rows."""
    m = classes.withColumn("m", measure(F.col("size_class")))
    down = Window.partitionBy("source").orderBy(F.desc("size_class"))
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum(F.col("words") * F.col("m")).over(Window.partitionBy("source")) - F.coalesce(F.sum(F.col("words") * F.col("m")).over(before), F.lit(0.0))
    # Without words from here on there is no t.
    m = m.withColumn("t", F.try_divide(F.col("target") - F.lit(float(most)) * F.coalesce(F.sum("words").over(before), F.lit(0)), rest))
    m = m.withColumn("fits", F.when(F.col("t") * F.col("m") <= F.lit(float(most) + 1e-9), F.struct(F.row_number().over(down).alias("at"), "t")))
    m = m.withColumn("t", F.min("fits").over(Window.partitionBy("source"))["t"])
    due = F.least(F.lit(float(most)), F.greatest(F.lit(0.0), F.coalesce(F.col("t") * F.col("m"), F.lit(float(most)))))
    return m.select("source", "size_class", F.when(F.col("target") > 0, due).otherwise(0.0).alias("due"))


def class_of(size: Column) -> Column:
    return F.floor(F.log2(F.greatest(size, F.lit(1)))).cast("int")


def draw_of(doc_id: Column, text: Column) -> Column:
    """52 bits that a document's id and text give, the same each time and in any engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("pareto"), doc_id.cast("string"), text)), 1, 13), 16, 10).cast("long")


def uniform() -> Column:
    """A number between 0 and 1 from the draw."""
    return (F.col("draw") + F.lit(0.5)) / F.lit(float(1 << 52))


def drawn(rows: DataFrame) -> DataFrame:
    """rows (draw, p) with their Pareto rank, a uniform number's odds over the odds of p, and the range (cell) that it falls in."""
    u = uniform()
    ranked = rows.withColumn("rank", F.when(F.col("p") > 0, (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))))
    return ranked.withColumn("cell", F.floor(F.col("rank") / (1 + F.col("rank")) * CELLS))


def first_reaching(ranges: DataFrame, at: str, start: Column) -> DataFrame:
    """source, cut, before, rest: of each source's ranges (source, at, words, rest) in order the first whose words, added to start and to those before, reach the rest."""
    up = Window.partitionBy("source").orderBy(at)
    ranges = ranges.withColumn("upto", start + F.sum("words").over(up))
    found = ranges.where(F.col("upto") >= F.col("rest")).groupBy("source").agg(F.min(F.struct(F.col(at).alias("cut"), (F.col("upto") - F.col("words")).alias("before"), "rest")).alias("x"))
    return found.select("source", "x.*")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES, sized: bool = False) -> DataFrame:
    """Every row of docs (doc_id, text, source and any others) with draw, size, source_size, target, copies and taken, in place of any columns of these names.

    A document is due some copies by its source's target and its size (odds_of): the whole part is certain, the rest is its
    inclusion probability p, which differs between documents of a source. They are ranked by the odds of a uniform number,
    which the MD5 of id and text gives, over the odds of p (Pareto order sampling), and are taken in that order until the source's
    words come as near its target as the last document allows. Ranks are cut in two steps: sums for each of CELLS ranges of
    the rank, then the order inside the one range where the target falls; no source is sorted as a whole, and texts stay
    where they are but for those of that range.

    Null texts have size 0 and are taken for nothing; a null source is a source of its own, ordered last; rows with equal id
    and text tie in rank and are interchangeable; an empty table gives an empty result. Two runs give equal results."""
    names = [c for c in docs.columns if c not in OWN]
    d = docs.select(*names, draw_of(F.col("doc_id"), F.col("text")).alias("draw"), word_count(F.col("text")).alias("size"))
    first = written(d.select("doc_id", "source", "draw", "size"), "mix-sizes")
    if sized:
        d, names = first, ["doc_id", "source"]
    classes = first.groupBy("source", class_of(F.col("size")).alias("size_class")).agg(F.sum("size").alias("words"))
    classes = written(classes, "mix-classes")
    # Tables of a row for each source, or source and class, have no more rows than this one.
    few = F.broadcast if classes.count() <= SOURCES else lambda df: df
    goals = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    same = lambda a, b: a["source"].eqNullSafe(b["g_source"])
    goals = goals.withColumnRenamed("source", "g_source")
    due = odds_of(classes.join(goals, same(classes, goals)).select("source", "size_class", "words", "target"), most)
    due = due.withColumn("certain", F.floor(F.col("due") + F.lit(1e-9)).cast("long")).withColumn("p", F.greatest(F.col("due") - F.col("certain"), F.lit(0.0)))
    due = due.withColumn("p", F.when(F.col("p") < 1e-9, 0.0).otherwise(F.col("p")))
    due = due.join(goals, same(due, goals)).select(F.col("source").alias("g_source"), F.col("size_class").alias("g_class"), "source_size", "target", "certain", "p")
    due = few(due)
    known = lambda rows: drawn(rows.join(due, rows["source"].eqNullSafe(due["g_source"]) & (class_of(rows["size"]) == due["g_class"]), "left").drop("g_source", "g_class"))
    cells = written(known(first).groupBy("source", "cell").agg(F.sum("size").alias("words"), F.sum(F.col("certain") * F.col("size")).alias("sure"), F.first("target").alias("target")), "mix-cells")
    rests = cells.groupBy("source").agg(F.greatest(F.max("target") - F.sum("sure"), F.lit(0.0)).alias("rest"))
    # One row a source: the first range that reaches the rest, found among STEP coarse ranges and then among the STEP fine ones in it, so that no
    # window has more rows. Where none does, all are taken.
    fine = cells.where("cell is not null").withColumn("coarse", F.floor(F.col("cell") / STEP))
    coarse = fine.groupBy("source", "coarse").agg(F.sum("words").alias("words"))
    coarse = first_reaching(coarse.join(rests.withColumnRenamed("source", "r_source"), F.col("source").eqNullSafe(F.col("r_source"))).drop("r_source"), "coarse", F.lit(0))
    inner = fine.join(few(coarse.withColumnRenamed("source", "c_source")), F.col("source").eqNullSafe(F.col("c_source")) & (F.col("coarse") == F.col("cut"))).select("source", "cell", "words", "rest", "before")
    cut = few(first_reaching(inner, "cell", F.col("before")).withColumnRenamed("source", "c_source").withColumnRenamed("cut", "cut_cell"))
    ranked = known(d).join(cut, F.col("source").eqNullSafe(F.col("c_source")), "left")
    at = F.coalesce(F.col("cell") == F.col("cut_cell"), F.lit(False))
    inside = Window.partitionBy("source", "cell").orderBy("rank", "size", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = ranked.where(at).withColumn("upto", F.col("before") + F.sum("size").over(inside))
    ahead = F.col("upto") - F.col("size")
    edge = edge.withColumn("extra", (F.abs(F.col("upto") - F.col("rest")) <= F.abs(ahead - F.col("rest"))) & (ahead <= F.col("rest"))).drop("upto")
    others = ranked.where(~at).withColumn("extra", F.coalesce(F.col("cell").isNotNull() & (F.col("cut_cell").isNull() | (F.col("cell") < F.col("cut_cell"))), F.lit(False)))
    copies = F.col("certain") + F.col("extra").cast("long")
    return others.unionByName(edge).select(*names, "draw", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, sized=True).select("doc_id", "size", "source_size", "target", "taken")


def mixed_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: each document as often as the mix takes it; the last stage, with a column copy (1, 2) in place of any of this name.

    Null texts, which have no words, are taken as often as their class is due; a null source is one source; repeated rows are
    dealt with one by one; an empty table gives an empty result."""
    plain = docs.select("doc_id", "text", "source", F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    out = mix(plain).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns if c.lower() != "copy"], "copy")


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size, (CAST(concat('0x', substr(md5(concat_ws(':', 'pareto', doc_id, text)), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / {float(1 << 52)} AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS n, [{', '.join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % {len(WEIGHTS)} + 1]::DOUBLE AS w FROM d GROUP BY source),
f AS (SELECT *, ({SHARE} * sum(n) OVER () - coalesce(sum({MOST_COPIES} * n) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS t, row_number() OVER (ORDER BY n / w, encode(source) NULLS LAST) AS place FROM s WINDOW b AS (ORDER BY n / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, n, least({MOST_COPIES} * n, w * coalesce((SELECT arg_min(t, place) FROM f WHERE {MOST_COPIES} * n >= w * t), 1e300)) AS target FROM f),
c AS (SELECT d.source, CAST(floor(log2(greatest(size, 1)) + 1e-9) AS INT) AS k, CAST(sum(size) AS DOUBLE) AS words, any_value(target) AS target FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source GROUP BY 1, 2),
h AS (SELECT *, pow(2, k / 2.0) AS m, (target - {MOST_COPIES} * coalesce(sum(words) OVER b, 0)) / nullif(sum(words * pow(2, k / 2.0)) OVER (PARTITION BY source) - coalesce(sum(words * pow(2, k / 2.0)) OVER b, 0), 0) AS t FROM c WINDOW b AS (PARTITION BY source ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT source, k, target, CASE WHEN target > 0 THEN least({MOST_COPIES}, coalesce(m * arg_max(t, k) FILTER (WHERE t * m <= {MOST_COPIES} + 1e-9) OVER (PARTITION BY source), {MOST_COPIES})) ELSE 0 END AS due FROM h),
e AS (SELECT d.*, o.target, floor(due + 1e-9) AS certain, CASE WHEN due - floor(due + 1e-9) > 1e-9 THEN due - floor(due + 1e-9) ELSE 0 END AS p FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source AND CAST(floor(log2(greatest(size, 1)) + 1e-9) AS INT) = o.k),
q AS (SELECT *, target - sum(certain * size) OVER (PARTITION BY source) AS rest, CASE WHEN p > 0 THEN u / (1 - u) * (1 - p) / p END AS rank FROM e),
v AS (SELECT r, rest, size, sum(size) OVER (PARTITION BY source ORDER BY rank, size, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM q WHERE p > 0),
x AS (SELECT r, upto - size <= rest AND abs(upto - rest) <= abs(upto - size - rest) AS extra FROM v)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(n AS BIGINT) AS source_size, q.target, CAST((certain + CASE WHEN extra THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM q JOIN g ON q.source IS NOT DISTINCT FROM g.source LEFT JOIN x USING (r)
"""
