"""Token counts: byte-pair merging with a heap and a linked list, without making identifiers."""

from __future__ import annotations

import heapq
import json
import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citelens.llm.shared import table

# Fixed values of byte-level BPE: how a text is cut before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LIMIT = 1024
VOCABULARY = "byte_bpe_50k.json"
CACHED = 400_000
LONG_PIECE = 48


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the others for U+0100 and on."""
    spare, letters = iter(range(256, 512)), []
    for b in range(256):
        printable = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255
        letters.append(chr(b if printable else next(spare)))
    return letters


def merged_length(symbols: list, ranks: dict) -> int:
    """Symbols left when the lowest-ranked adjacent pair, the leftmost among equals, is merged again and again."""
    n = len(symbols)
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [(ranks[pair], i, *pair) for i, pair in enumerate(zip(symbols, symbols[1:])) if pair in ranks]
    heapq.heapify(heap)
    left, merges = list(symbols), 0
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if left[i] != a or j < 0 or left[j] != b:
            continue
        left[i], left[j], k = a + b, None, after[j]
        after[i] = k
        merges += 1
        if k >= 0:
            before[k] = i
            if (rank := ranks.get((a + b, left[k]))) is not None:
                heapq.heappush(heap, (rank, i, a + b, left[k]))
        if (p := before[i]) >= 0 and (rank := ranks.get((left[p], a + b))) is not None:
            heapq.heappush(heap, (rank, p, left[p], a + b))
    return n - merges


class PieceLengths(dict):
    """Tokens of each piece, remembered up to a fixed number of pieces."""

    def __init__(self, ranks: dict):
        self.ranks, self.letters = ranks, byte_letters()

    def __missing__(self, piece: str) -> int:
        n = merged_length([self.letters[b] for b in piece.encode()], self.ranks)
        if len(piece) <= LONG_PIECE:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = n
        return n


class Counter:
    """Counts a text's tokens as the vocabulary file's own library does. Strings of added special tokens inside a text are one token each."""

    _made: dict = {}

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)
        merges = (m.split(" ") if isinstance(m, str) else m for m in vocabulary["model"]["merges"])
        special = sorted((t["content"] for t in vocabulary["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pieces = regex.compile(PIECES)
        self.lengths = PieceLengths({tuple(m): i for i, m in enumerate(merges)})

    @classmethod
    def of(cls, path: str) -> Counter:
        """One for each worker process. A bare file name is looked up there among the public tokenizers, so that driver and executors need no common place."""
        if not os.path.isabs(path):
            import public_tokenizers

            path = public_tokenizers.path(path)
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def plain(self, text: str) -> int:
        return sum(map(self.lengths.__getitem__, self.pieces.findall(text)))

    def count(self, text: str) -> int:
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self.plain, parts))
        return self.plain(text)


def token_count(text: Column, vocabulary: str) -> Column:
    """Tokens of a text; null counts as the empty text, which has none."""

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        counter = Counter.of(vocabulary)
        return pd.Series([counter.count(t) if t else 0 for t in texts], dtype="int64")

    return counted(text)


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit in place of any columns of these names. vocabulary is a file's path, or the name of one of the public tokenizers.

    Null texts count as empty: 0 bytes, 0 tokens. Whole texts are counted, however long. Repeated rows stay,
    each with its own count; an empty table gives an empty result; other columns pass through unchanged."""
    whole = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumns({"n_bytes": F.octet_length(whole).cast("long"), "n_tokens": token_count(F.col(text), vocabulary)})
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, VOCABULARY).select("doc_id", "n_bytes", "n_tokens", "over_limit")
