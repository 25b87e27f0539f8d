"""Streams: scoring of arriving contexts, folding of the judgement log, resumed runs. Each runs what is there and ends, and resumes from its checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelens.functions.text import letter_words
from citelens.operators.ranking import ranked
from citelens.plans.vectors import normalized, products


def run_available(stream: DataFrame, batch, checkpoint: str, mode: str = "append") -> None:
    """Give each micro-batch to batch(df, epoch) until what is there is done."""
    q = stream.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def score_contexts(stream: DataFrame, model: DataFrame, out: str, checkpoint: str, most: int = 5) -> None:
    """Rank candidates (cand, term, w) for arriving contexts (q, text); a batch's result is written once, under its epoch.

    A context without any term of the model has no row."""
    def score(df: DataFrame, epoch: int) -> None:
        words = df.select("q", F.explode(letter_words(F.col("text"))).alias("term")).groupBy("q", "term").agg(F.count("*").cast("double").alias("w"))
        top = ranked(products(normalized(words, "q"), model), "q", F.col("score"), "cand", most)
        top.where("score > 0").write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    run_available(stream, score, checkpoint)


def fold_judgements(stream: DataFrame, keys: list[str], value: str, order: list[str], out: str, checkpoint: str) -> None:
    """The first value of each key by order, kept as state; the whole table is written after each batch."""
    first = stream.groupBy(*keys).agg(F.min(F.struct(*order, value)).alias("__first"))

    def keep(df: DataFrame, epoch: int) -> None:
        df.select(*keys, F.col(f"__first.{value}").alias(value)).write.mode("overwrite").parquet(out)

    run_available(first, keep, checkpoint, "complete")


def append_log(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Append arriving lines to a table; files that were read are never read again."""
    q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
    q.awaitTermination()
