"""Spans that need a scan with state: word windows around markers, and sentences with abbreviations. Arrow-batched."""

from __future__ import annotations

import re
import string

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelens.functions.text import MARKER

_PUNCT = re.escape(string.punctuation)
_FORWARD = re.compile(rf"({MARKER})|([^\s{_PUNCT}]+)")
#: Words that no sentence ends with, though a full stop follows.
ABBREVIATIONS = ("al", "fig", "e.g", "i.e", "eq", "cf", "ref", "refs")
_END = re.compile(r"[.!?]+[\"')\]]*(?=\s|$)")
_ABBREVIATED = re.compile(rf"(?:^|[\s(])(?:{'|'.join(map(re.escape, ABBREVIATIONS))})\.$", re.I)


def window_length(text: str, words: int, backwards: bool = False) -> int:
    """Characters to pass, from the text's start or end, until so many words are passed; markers are jumped and are no words."""
    found = [(m.start(), m.end()) for m in _FORWARD.finditer(text) if m[2]]
    if words <= 0:
        return 0
    if len(found) < words:
        return len(text)
    return len(text) - found[-words][0] if backwards else found[words - 1][1]


def sentences(text: str) -> list[tuple[int, int]]:
    out, start = [], 0
    for m in _END.finditer(text):
        if m[0] == "." and _ABBREVIATED.search(text, start, m.end()):
            continue
        body = text[start : m.end()]
        if body.strip():
            out.append((start + len(body) - len(body.lstrip()), m.end()))
        start = m.end()
    body = text[start:]
    if body.strip():
        out.append((start + len(body) - len(body.lstrip()), start + len(body.rstrip())))
    return out


def sentence_window(text: str, at: int, count: int) -> tuple[int, int]:
    """Characters to pass backwards and forwards from a place to take in the sentence that it is in and (count - 1) / 2 on either side; all there are where
    there are fewer. A place between sentences counts for the next one, one behind the last for the last."""
    spans, each = sentences(text), (count - 1) // 2
    if not spans:
        return at, len(text) - at
    own = next((i for i, (_, end) in enumerate(spans) if at < end), len(spans) - 1)
    before = at - spans[own - each][0] if own >= each else at
    after = spans[own + each][1] - at if own + each < len(spans) else len(text) - at
    return max(before, 0), max(after, 0)


def word_window(text: Column, words: int, backwards: bool) -> Column:
    @F.pandas_udf("long")
    def length(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else window_length(t, words, backwards) for t in texts], dtype="Int64")

    return length(text)


def sentence_spans(text: Column) -> Column:
    @F.pandas_udf("array<struct<start: int, end: int>>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [{"start": a, "end": b} for a, b in sentences(t)] for t in texts])

    return found(text)


def sentence_distance(text: Column, at: Column, count: int) -> Column:
    """Struct of before and after: the characters of a window of so many sentences around a place."""
    @F.pandas_udf("before long, after long")
    def found(texts: pd.Series, places: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if t is None or pd.isna(p) else sentence_window(t, int(p), count) for t, p in zip(texts, places)]
        return pd.DataFrame(rows, columns=["before", "after"]).astype("Int64")

    return found(text, at)


def middle_distance(rows: DataFrame, count: int) -> DataFrame:
    """doc_id, before, after of texts (doc_id, text): the characters of a window of so many sentences around the place right behind the first character of the middle
    sentence, where it has a second one. Texts are read one at a time from a batch, and only numbers leave: a worker never holds a batch's sentences."""
    def found(batches):
        import pyarrow as pa

        for batch in batches:
            kept, places = [], []
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                own = sentences(text) if text else []
                start, end = own[(len(own) - 1) // 2] if own else (0, 0)
                if end > start + 1:
                    kept.append(i)
                    places.append(sentence_window(text, start + 1, count))
            numbers = [pa.array([p[k] for p in places], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), *numbers], ["doc_id", "before", "after"])

    return rows.select("doc_id", "text").mapInArrow(found, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, before long, after long")
