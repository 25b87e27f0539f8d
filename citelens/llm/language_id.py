"""Language identification by the nearest of several TF-IDF n-gram centroids per language, with distance-based rejection."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citelens.llm.shared import table, written

UNKNOWN = "und"
DIMENSIONS = 1 << 15
#: The fit is on at most so many labelled documents of each language, those with the least hash.
SAMPLE_PER_LANGUAGE = 400
CENTROIDS = 4
#: Label values up to which their counts, a row each, are broadcast.
MOST_LANGUAGES = 10_000
#: A text is rejected below this quantile of the cosines of texts of its own length and language that were kept from the centroids.
REJECT_QUANTILE = 0.005
#: Numbers of letters at which the bar is set; between them it is interpolated on a log scale, below the least it falls to 0.
LENGTHS = np.array([15, 30, 60, 120, 250, 500, 1000, 2000, 4000, 8000])
#: A length with fewer texts takes in the next shorter ones, so that no bar is that of a few long texts.
LEAST_TEXTS = 50
#: A cluster has at least this share of its language's texts, so that no centroid is one odd text.
LEAST_SHARE = 0.02

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For each code point, its lower-case letter, or a space if it is no letter."""
    if not _letters:
        out = np.full(0x110000, 32, dtype=np.uint32)
        for c in range(0x110000):
            if (ch := chr(c)).isalpha():
                out[c] = ord(low) if len(low := ch.lower()) == 1 else c
        _letters.append(out)
    return _letters[0]


def gram_counts(text: str) -> tuple[np.ndarray, int]:
    """Logarithms of 1 + hashed counts of the 1- to 3-grams of letters, white space and all else being one space; and the number of letters.

    Bare counts are ruled by the letters that all languages of a script share, and bring foreign languages near."""
    s = letter_table()[np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)]
    gap = s == 32
    letters = int(len(s) - np.count_nonzero(gap))
    if not letters:
        return np.zeros(DIMENSIONS), 0
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    s = np.concatenate(([32], s[keep], [32])).astype(np.uint32)
    k = np.uint32(0x9E3779B1)
    one = s * k
    two = (one[:-1] ^ (s[1:] * np.uint32(0x85EBCA6B))) * k
    three = (two[:-1] ^ (s[2:] * np.uint32(0xC2B2AE35))) * k
    shift = np.uint32(32 - 15)
    counts = np.bincount(np.concatenate((one[1:-1] >> shift, two >> shift, three >> shift)), minlength=DIMENSIONS)
    return np.log1p(counts), letters


@dataclass
class Model:
    """Languages in order, the IDF of each hashed gram, unit centroids, the language of each, and the least cosine that each language accepts at each of LENGTHS."""

    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    of: np.ndarray
    bar: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine to the nearest centroid (0 to 1), and whether that is too far."""
        counts, letters = gram_counts(text) if text else (None, 0)
        if not letters or not self.languages:
            return UNKNOWN, 0.0, True
        v = (counts * self.idf).astype(np.float32)
        cosines = self.centroids @ (v / max(np.linalg.norm(v), 1e-12))
        best = int(np.argmax(cosines))
        score = float(min(1.0, max(0.0, cosines[best])))
        bar = np.interp(np.log(letters), np.log(LENGTHS), self.bar[self.of[best]]) * min(1.0, letters / LENGTHS[0])
        return self.languages[self.of[best]], round(score, 6), bool(score < bar)


def spherical_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Up to k unit means by cosine. Starts from rows far apart in the nearer three quarters, so it is the same each time; a small cluster joins the others."""
    to_mean = x @ x.mean(axis=0)
    inner = x[to_mean >= np.quantile(to_mean, 0.25)]
    seeds = [int(np.argmax(inner @ x.mean(axis=0)))]
    while len(seeds) < min(k, len(inner)):
        seeds.append(int(np.argmin((inner @ inner[seeds].T).max(axis=1))))
    means = inner[seeds]
    while True:
        for _ in range(rounds):
            near = np.argmax(x @ means.T, axis=1)
            for j in range(len(means)):
                if (near == j).any():
                    m = x[near == j].sum(axis=0)
                    means[j] = m / max(np.linalg.norm(m), 1e-12)
        members = np.bincount(np.argmax(x @ means.T, axis=1), minlength=len(means))
        least = int(np.argmin(members))
        if len(means) == 1 or members[least] >= max(2, LEAST_SHARE * len(x)):
            return means
        means = np.delete(means, least, axis=0)


def first_letters(text: str, most: int) -> str:
    """The text up to its letter number most."""
    s = letter_table()[np.frombuffer(text[: 64 * most].encode("utf-32-le", "replace"), dtype=np.uint32)]
    at = np.flatnonzero(s != 32)
    return text[: at[most - 1] + 1] if len(at) >= most else text


def least_cosines(texts: list[str], own: np.ndarray, idf: np.ndarray, k: int) -> np.ndarray:
    """A language's bar at each of LENGTHS: each half of its texts, cut to each length and whole, is held against centroids of the other half."""
    found: list[list[float]] = [[] for _ in LENGTHS]
    halves = (0, 1) if len(texts) > 1 else (0,)
    for half in halves:
        means = spherical_means(own[1 - half :: 2] if len(halves) == 2 else own, k)
        for text in texts[half::2]:
            letters = gram_counts(text)[1]
            for cut in [*(n for n in LENGTHS if n < letters), letters]:
                v = (gram_counts(first_letters(text, int(cut)))[0] * idf).astype(np.float32)
                band = min(int(np.searchsorted(LENGTHS, cut)), len(LENGTHS) - 1)
                found[band].append(float((means @ v).max() / max(np.linalg.norm(v), 1e-12)))
    for j in range(len(LENGTHS) - 1, 0, -1):
        for i in range(j - 1, -1, -1):
            if len(found[j]) >= LEAST_TEXTS:
                break
            found[j] = found[j] + found[i]
    had = [j for j, c in enumerate(found) if c]
    return np.interp(np.log(LENGTHS), np.log(LENGTHS[had]), [float(np.quantile(found[j], REJECT_QUANTILE)) for j in had])


def fit(texts: list[str], langs: list[str], k: int = CENTROIDS) -> Model:
    """A model of labelled texts; texts without letters and null labels are left out. No usable text: a model that rejects all."""
    rows = [((at := np.flatnonzero(c), c[at].astype(np.float32)), lang, t) for t, lang in zip(texts, langs) if t and lang is not None for c, n in [gram_counts(t)] if n]
    languages = sorted({lang for _, lang, _ in rows})
    if not rows:
        return Model([], np.ones(DIMENSIONS), np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, int), np.zeros((0, len(LENGTHS))))
    seen = np.zeros(DIMENSIONS)
    for (at, _), _, _ in rows:
        seen[at] += 1
    idf = np.log((1 + len(rows)) / (1 + seen)) + 1
    centroids, of, bar = [], [], []
    for i, lang in enumerate(languages):  # one language's vectors are in memory at a time
        mine = [(c, t) for c, other, t in rows if other == lang]
        own = np.zeros((len(mine), DIMENSIONS), dtype=np.float32)
        for row, ((at, c), _) in zip(own, mine):
            row[at] = c * idf[at]
        own /= np.linalg.norm(own, axis=1, keepdims=True)
        means = spherical_means(own, k)
        centroids.extend(means)
        of.extend([i] * len(means))
        bar.append(least_cosines([t for _, t in mine], own, idf, k))
    return Model(languages, idf, np.array(centroids, dtype=np.float32), np.array(of), np.array(bar))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 3, is 1. A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on the labelled documents that are not held out: at most per_language of each, those with the least hash of id and text.

    The driver gets about three times as many. Rows with equal id and text count once, so they cannot add up there; null labels,
    null texts and texts without letters are left out; an empty table gives a model that rejects all."""
    pool = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    pool = pool.select("lang", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).alias("h"))
    sizes = docs.where(F.col("lang").isNotNull()).groupBy("lang").count()
    share = sizes.select("lang", (F.lit(3.0 * per_language * (1 << 30)) / F.col("count")).alias("most"))
    share = written(share, "language-shares")
    if share.count() <= MOST_LANGUAGES:
        share = F.broadcast(share)
    few = pool.join(share, "lang").where("h < most").select("lang", "text", "h").distinct()
    rows = sorted(few.toLocalIterator(), key=lambda r: (r.lang, r.h, zlib.crc32(r.text.encode())))
    kept, n = [], {}
    for r in rows:
        n[r.lang] = n.get(r.lang, 0) + 1
        if n[r.lang] <= per_language:
            kept.append(r)
    return fit([r.text for r in kept], [r.lang for r in kept])


def prediction(text: Column, model: Model) -> Column:
    """Struct of lang_pred, score and rejected. The model goes to the executors once; its size is fixed by the number of languages."""
    spark = SparkSession.getActiveSession()
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([held.value.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    return predicted(text)


def language_of(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with a struct column language_id (lang_pred, score, rejected), in place of any column of this name.

    Null texts and texts without letters: und, score 0, rejected. Whole texts are read. Repeated rows stay and get
    equal results; an empty table gives an empty result; other columns pass through."""
    return docs.withColumn("language_id", prediction(F.col(text), model))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language_of(docs.select("doc_id", "text"), learn(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "language_id.*")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: documents whose language is recognised stay. Null texts and texts without letters go; repeated rows share their fate; an empty table stays empty."""
    return docs.where(~prediction(F.col("text"), learn(docs))["rejected"])
