"""Substring dedup: runs of consecutive sentences are hashed and joined globally; sentences under a run that is not the first of its kind go."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelens.llm.shared import bounded, forget, table, written

#: Every window of so many consecutive sentences is hashed. A longer run repeats only where all its windows do, so these find every run of two or more.
SENTENCES = 2
#: ASCII marks and those of scripts with spaces end a sentence before white space; the wide marks end one wherever they stand.
SENTENCE = re.compile(r"[^.!?…؟۔।॥。！？｡\n]*(?:([。！？｡]+[”’」』）]*\s*)|[.!?…؟۔।॥]+(?=\s|\Z)\s*|\n\s*|[.!?…؟۔।॥]+|\Z)")
OCCURRENCE = "h1 long, h2 long, doc_id {kind}, text_key long, a int"


def sentences(text: str) -> list[str]:
    """Sentences with the white space after them; together they are the text."""
    out, held = [], ""
    for m in SENTENCE.finditer(text):
        held += m[0]
        if held and (m[1] or held[-1].isspace() or m.end() == len(text)):
            if held.strip() or not out:
                out.append(held)
            else:
                out[-1] += held
            held = ""
    return out


def runs(parts: list[str]) -> list[tuple[int, int]]:
    """First and last + 1 sentence of each run, however short its sentences are."""
    return [(a, a + SENTENCES) for a in range(len(parts) - SENTENCES + 1)]


def run_hash(words: list[str]) -> tuple[int, int]:
    """128 bits of a run, given each sentence's words in lower case with single spaces."""
    d = hashlib.blake2b(" ".join(words).encode("utf-8", "replace"), digest_size=16).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def occurrences(docs: DataFrame) -> DataFrame:
    """A row for each run: its hash, and where it begins. Rows with equal id and text are one document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def made(batches):
        for batch in bounded(batches):
            ids, h1, h2, places = [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                parts = sentences(text) if text else []
                words = [" ".join(p.lower().split()) for p in parts]
                for a, b in runs(parts):
                    x, y = run_hash(words[a:b])
                    ids.append(i)
                    h1.append(x)
                    h2.append(y)
                    places.append(a)
            one = pa.array(ids, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), batch.column(0).take(one), batch.column(1).take(one), pa.array(places, pa.int32())], names=["h1", "h2", "doc_id", "text_key", "a"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(made, OCCURRENCE.format(kind=kind))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, starts: the runs of each document that occur before it, by (doc_id, place). Null ids come first.

    Each run is hashed once and written. Counts and first places are summed up before the shuffle, so a passage in a third
    of all documents costs one row per task there; only runs that occur twice take part in the join, whose hot keys Spark splits."""
    found = written(occurrences(docs), "dedup-runs")
    place = F.struct("doc_id", "text_key", "a")
    firsts = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    firsts = written(firsts.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "first"), "dedup-repeats")
    later = found.join(firsts, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))).where(place > F.col("first"))
    spans = written(later.groupBy("doc_id", "text_key").agg(F.collect_set("a").alias("starts")), "dedup-spans")
    forget(found, firsts)
    return spans


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_sentences, n_removed, n_chars_removed of each row of docs (doc_id, text): the text without the sentences under repeated runs.

    Null texts stay null and have no sentences; empty texts and texts of one sentence stay as they are; very long texts are read whole. A run repeated inside one document loses its later places too. Rows with equal id and text are one
    document and get equal results. An empty table gives an empty result; other columns are not carried."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text")
    spans = repeated_spans(docs).toDF("s_id", "s_key", "starts")
    keyed = docs.withColumn("text_key", F.xxhash64("text"))
    both = keyed.join(spans, keyed["doc_id"].eqNullSafe(spans["s_id"]) & (keyed["text_key"] == spans["s_key"]), "left").select("doc_id", "text", "starts")

    def cut(batches):
        for batch in bounded(batches):
            rows = []
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                parts = sentences(text) if text else []
                drop = {i for a in gone or () for i in range(a, a + SENTENCES)}
                kept = text if not drop else "".join(p for i, p in enumerate(parts) if i not in drop)
                rows.append((kept, len(parts), len(drop), len(text) - len(kept) if drop else 0))
            text, n, removed, chars = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(chars, pa.int64())], names=["doc_id", "text", "n_sentences", "n_removed", "n_chars_removed"])

    return both.mapInArrow(cut, f"doc_id {kind}, text string, n_sentences long, n_removed long, n_chars_removed long")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))


#: Marks end a sentence before white space, wide marks anywhere; a sentence goes on over the white space behind it.
ORACLE_SQL = r"""
WITH a AS (SELECT dense_rank() OVER (ORDER BY doc_id, text) AS r, doc_id, text FROM documents),
d AS (SELECT DISTINCT r, doc_id, string_split(regexp_replace(text, '([。！？｡]+[”’」』）]*\s*|[.!?…؟۔।॥]+\s+|\n\s*)', '\1␞', 'g'), '␞') AS p FROM a),
s AS (SELECT r, doc_id, p[i] AS s, i FROM (SELECT r, doc_id, list_filter(p, lambda x: x <> '') AS p, unnest(range(1, len(list_filter(p, lambda x: x <> '')) + 1)) AS i FROM d)),
k AS (SELECT r, doc_id, i, lower(trim(regexp_replace(s, '\s+', ' ', 'g'))) AS k FROM s),
v AS (SELECT r, doc_id, i, trim(concat(k, ' ', lead(k) OVER (PARTITION BY r ORDER BY i))) AS k, lead(i) OVER (PARTITION BY r ORDER BY i) AS more FROM k),
o AS (SELECT r, i, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, r, i) > 1 AS again FROM v WHERE more IS NOT NULL),
gone AS (SELECT DISTINCT r, unnest([i, i + 1]) AS i FROM o WHERE again),
t AS (SELECT s.r, count(*) AS n, count(gone.i) AS n_removed, coalesce(sum(length(s.s)) FILTER (WHERE gone.i IS NOT NULL), 0) AS chars, string_agg(s.s, '' ORDER BY s.i) FILTER (WHERE gone.i IS NULL) AS kept FROM s LEFT JOIN gone ON gone.r = s.r AND gone.i = s.i GROUP BY s.r)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(kept, '') END AS text, CAST(coalesce(n, 0) AS BIGINT) AS n_sentences, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(chars, 0) AS BIGINT) AS n_chars_removed FROM a LEFT JOIN t USING (r)
"""
