"""Context records and other delimited lines. Parsing works on a column of lines, so it serves files, streams and tables alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Separators of records, of list items, and of all from marker phrases.
RECORD, ITEM, PART = "\u241e", "\u241f", "\u241d"


def items(c: Column) -> Column:
    """A list; of an empty string an empty one."""
    return F.filter(F.split(c, ITEM), lambda x: x != "")


def parse_contexts(lines: DataFrame, value: str = "value") -> DataFrame:
    """cited_id, adjacent, citing_id, text, fos, claim, np_all, np_marker of lines with 1, 4, 5, 6 or 7 fields; absent fields are null."""
    f = F.split(F.col(value), RECORD)
    at = lambda i: F.try_element_at(f, F.lit(i))
    full = F.size(f) >= 4
    np = F.split(at(7), PART)
    claim = "array<struct<weight:double,terms:array<string>>>"
    return lines.select(
        F.when(full, at(1)).alias("cited_id"), F.when(full, items(at(2))).alias("adjacent"), F.when(full, at(3)).alias("citing_id"), F.when(full, at(4)).otherwise(at(1)).alias("text"),
        F.when(F.size(f) >= 5, items(at(5))).alias("fos"), F.when(F.size(f) >= 6, F.from_json(at(6), claim)).alias("claim"),
        F.when(F.size(f) >= 7, items(F.try_element_at(np, F.lit(1)))).alias("np_all"), F.when(F.size(f) >= 7, items(F.try_element_at(np, F.lit(2)))).alias("np_marker"),
    )


def context_lines(contexts: DataFrame) -> DataFrame:
    """value: the line of each context (cited_id, adjacent, citing_id, text, fos)."""
    return contexts.select(F.concat_ws(RECORD, "cited_id", F.array_join("adjacent", ITEM), "citing_id", "text", F.array_join("fos", ITEM)).alias("value"))


def read_contexts(spark: SparkSession, path: str) -> DataFrame:
    return parse_contexts(spark.read.text(path))


def write_contexts(contexts: DataFrame, path: str) -> None:
    context_lines(contexts).write.text(path)


def parse_ragged(lines: DataFrame, fields: int, value: str = "value") -> DataFrame:
    """f1 .. fn of comma-separated lines, the last field taking all further commas."""
    f = F.split(F.col(value), ",", fields)
    return lines.select(*[F.try_element_at(f, F.lit(i + 1)).alias(f"f{i + 1}") for i in range(fields)])


def parse_pairs(lines: DataFrame, value: str = "value") -> DataFrame:
    """a, b, text of lines `1,2,"text"` with or without quotes; other lines go."""
    pattern = r'^(\d+),(\d+),"?(.+?)"?$'
    m = lambda i: F.regexp_extract(value, pattern, i)
    return lines.where(F.col(value).rlike(pattern)).select(m(1).cast("long").alias("a"), m(2).cast("long").alias("b"), m(3).alias("text"))


def parse_judgements(lines: DataFrame, value: str = "value") -> DataFrame:
    """ts, uid, item, marks of judgement lines with a JSON object at the end."""
    f = F.split(F.col(value), ITEM, 4)
    return lines.select(F.timestamp_seconds(f[0].cast("long")).alias("ts"), f[1].alias("uid"), f[2].cast("int").alias("item"), F.from_json(f[3], "map<string,string>").alias("marks"))


def parse_named_numbers(lines: DataFrame, value: str = "value") -> DataFrame:
    """name, number of lines `name: 12`; other lines go."""
    f = F.split(F.col(value), ": ")
    return lines.select(f[0].alias("name"), F.try_to_number(F.try_element_at(f, F.lit(2)), F.lit("9999999999")).cast("long").alias("number")).where("number IS NOT NULL")
