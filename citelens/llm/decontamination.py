"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over training token windows, with verified hits."""

from __future__ import annotations

import pickle
import re
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citelens.llm.shared import new_folder, opened, table

WINDOW = 10
#: A task holds windows of so many benchmark words at most, and so much is broadcast; of more, each block is a file that tasks read in turn.
BLOCK_WORDS = 2_000_000
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_BITS = 20


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII digits, ASCII letters in lower case, and any characters beyond ASCII, as UTF-8."""
    return WORD.findall(text.encode("utf-8").lower()) if text else []


def rolling(words: list[bytes], n: int) -> np.ndarray:
    """A 64-bit hash of each run of n words; it differs between processes, so it never leaves one."""
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out *= _FACTOR
        out += h[i : len(h) - n + 1 + i]
    return out ^ (out >> np.uint64(29))


class Windows:
    """The windows of some benchmark items, by length: sorted hashes, and where each window is. Hashed anew in each process."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.names = [item for item, _ in items]
        self.words = [w for _, words in items for w in words]
        self.begins = np.cumsum([0, *(len(words) for _, words in items)])
        self.window, self.by_length = window, None

    def __getstate__(self):
        return self.names, b" ".join(self.words), self.begins, self.window

    def __setstate__(self, state):
        self.names, words, self.begins, self.window = state
        self.words, self.by_length = words.split(b" ") if words else [], None

    def index(self) -> dict:
        if self.by_length is None:
            made: dict[int, list] = {}
            for item, (a, b) in enumerate(zip(self.begins[:-1].tolist(), self.begins[1:].tolist())):
                n = min(self.window, b - a)
                if n:
                    made.setdefault(n, []).append((rolling(self.words[a:b], n), item, a))
            self.by_length = {}
            for n, found in sorted(made.items()):
                h = np.concatenate([x for x, _, _ in found])
                item = np.repeat(np.array([i for _, i, _ in found]), [len(x) for x, _, _ in found])
                at = np.concatenate([a + np.arange(len(x)) for x, _, a in found])
                order = np.argsort(h, kind="stable")
                seen = np.zeros(1 << _BITS, dtype=bool)
                seen[h >> np.uint64(64 - _BITS)] = True
                self.by_length[n] = seen, h[order], item[order], at[order]
        return self.by_length

    def scan(self, words: list[bytes]) -> tuple[set, list[tuple[int, int]]]:
        """Items with a window in these words, and the runs of words that windows cover (first, last + 1), joined where they touch."""
        items, covered = set(), []
        for n, (seen, known, item, at) in self.index().items():
            if len(words) < n:
                break
            h = rolling(words, n)
            near = np.flatnonzero(seen[h >> np.uint64(64 - _BITS)])
            first, last = np.searchsorted(known, h[near]), np.searchsorted(known, h[near], side="right")
            for i, a, b in zip(near.tolist(), first.tolist(), last.tolist()):
                own = [k for k in range(a, b) if self.words[at[k] : at[k] + n] == words[i : i + n]]
                if own:
                    items.update(self.names[item[k]] for k in own)
                    covered.append((i, i + n))
        return items, joined(covered)


def joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame, most: int = BLOCK_WORDS):
    """The benchmark's items with words, in blocks of a bounded number of words; the driver holds one block at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), "text").where("item_id is not null").toLocalIterator():
        words = words_of(row.text)
        if block and size + len(words) > most:
            yield block
            block, size = [], 0
        if words:
            block.append((row.i, words))
            size += len(words)
    yield block


class Held:
    """Blocks of windows for the executors: one is broadcast; of several, each is a file in the shared folder, of which a task holds one at a time."""

    def __init__(self, spark: SparkSession, benchmark: DataFrame, most: int, window: int):
        self.broadcast, self.files = None, []
        made = (Windows(block, window) for block in blocks(benchmark, most))
        first, second = next(made), next(made, None)
        if second is None:
            self.broadcast = spark.sparkContext.broadcast(first)
            return
        folder = new_folder(spark, "benchmark-blocks")
        store, path = opened(folder)
        store.create_dir(path, recursive=True)
        for i, windows in enumerate(chain((first, second), made)):
            with store.open_output_stream(f"{path}/{i}") as out:
                out.write(pickle.dumps(windows))
            self.files.append(f"{folder}/{i}")

    def each(self):
        if self.broadcast is not None:
            yield self.broadcast.value
        for file in self.files:
            store, path = opened(file)
            with store.open_input_stream(path) as f:
                yield pickle.loads(f.read())


def contamination(text: Column, benchmark: DataFrame, most: int = BLOCK_WORDS, window: int = WINDOW) -> Column:
    """Struct of n_words, n_hit, items (sorted) and runs (of words, joined): one function, whatever the number of blocks. Further blocks read the texts of a batch again."""
    held = Held(benchmark.sparkSession, benchmark, most, window)

    @F.pandas_udf("n_words long, items array<string>, runs array<struct<a: int, b: int>>")
    def scanned(texts: pd.Series) -> pd.DataFrame:
        sizes, items, runs = [0] * len(texts), [set() for _ in texts], [[] for _ in texts]
        for windows in held.each():
            for i, t in enumerate(texts):
                words = words_of(t)
                sizes[i] = len(words)
                more, covered = windows.scan(words)
                items[i] |= more
                runs[i] = joined(runs[i] + covered) if runs[i] and covered else runs[i] or covered
        return pd.DataFrame({"n_words": sizes, "items": [sorted(x) for x in items], "runs": [[{"a": a, "b": b} for a, b in x] for x in runs]})

    return scanned(text)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", most: int = BLOCK_WORDS) -> DataFrame:
    """docs with a struct column contamination (n_words, items, runs), in place of any column of this name.

    A null text has no words. An item without words, or with a null id, has no window. Items with equal windows are
    all reported; whole texts are read, however long; repeated rows stay; an empty documents table gives an empty result, an empty benchmark no hits."""
    return docs.withColumn("contamination", contamination(F.col(text), benchmark, most))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    hit = F.aggregate(c["runs"], F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"])
    return found.select("doc_id", c["n_words"].alias("n_words"), hit.alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: documents with a benchmark window go. Null and empty texts have none and stay, repeated rows share their fate, and an empty table or benchmark changes nothing."""
    return docs.where(F.size(contamination(F.col("text"), table(spark, sf_dir, "benchmark"))["items"]) == 0)


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
hits AS (SELECT rid, dw.n, i, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
cover AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
found AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (rid) LEFT JOIN found USING (rid)
"""
