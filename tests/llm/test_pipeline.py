"""The pipeline's stages one by one against plain Python on a small table."""

from collections import Counter

from conftest import DATA
from test_operators import base_spans, brute_groups, brute_targets
from test_queries import plain_hits, plain_windows

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from citelens.llm import language_id


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language id", "near duplicates", "decontamination", "secret scan", "mixing"]
    at = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [r for r in at.collect()]
        out = stage(spark, at, DATA)
        after = out.collect()
        if k < 4:
            assert out.columns == docs.columns
        if name == "language id":
            model = language_id.learn(at)
            assert {r.doc_id for r in after} == {r.doc_id for r in before if not model.predict(r.text)[2]}
        elif name == "near duplicates":
            kept = {d for d, n, c in brute_groups([(r.doc_id, r.text) for r in before]) if n == 0 or d == c}
            assert Counter(r.doc_id for r in after) == Counter(kept)
        elif name == "decontamination":
            windows = plain_windows((r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect())
            assert {r.doc_id for r in after} == {r.doc_id for r in before if not plain_hits(r.text, windows)[0]}
        elif name == "secret scan":
            assert len(after) == len(before) and not any(base_spans(r.text) for r in after)
            assert all(r.n_chars == len(r.text) for r in after)
        else:
            words = Counter()
            for r in before:
                words[r.source] += len(r.text.split())
            assert set(out.columns) == set(docs.columns) | {"copy"}
            assert max(Counter(r.doc_id for r in after).values()) <= 2
            # Each source's words come as near its target as its longest document allows.
            want, got = brute_targets(words), Counter()
            for r in after:
                got[r.source] += len(r.text.split())
            assert all(abs(got[s] - want[s]) <= max(len(r.text.split()) for r in before if r.source == s) / 2 + 1 for s in words)
            total = sum(len(r.text.split()) for r in after)
            assert abs(total - 1.5 * sum(words.values())) < 0.05 * sum(words.values())
        at = spark.createDataFrame(after, out.schema)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, name, stage):
    """Nulls in any column, empty texts, repeated rows, columns with the operators' own names, and an empty table."""
    long = " ".join(f"word{i % 97} und" for i in range(30_000))
    rows = [(1, None, "en", "s", 1), (2, "", None, None, None), (3, long, "en", None, 3), (4, "a token=abcdefghijklmnop here", "en", "s", 0), (4, "a token=abcdefghijklmnop here", "en", "s", 0), (None, "no id at all in this row", "de", "t", None), (5, "no id at all in this row", None, "t", 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = ("secrets", "contamination", "language_id", "text_key", "gone", "maybe", "own_key", "rank", "cell", "p", "size", "copies", "row", "n_shingles", "component_id", "m_id", "__text", "__id")
    d = d.withColumns({c: F.lit("clash") for c in clash})
    out = stage(spark, d, DATA)
    got = out.collect()
    last = name == corpus_pipeline.STAGES[-1][0]
    assert [c for c in out.columns if c != "copy"] == d.columns and ("copy" in out.columns) == last
    assert all(r["gone"] == r["rank"] == "clash" for r in got)
    ids = Counter(r.doc_id for r in got)
    if name == "near duplicates":
        assert ids == Counter([1, 2, 3, 4, 5])
    elif name in ("decontamination", "secret scan"):
        assert ids == Counter(r[0] for r in rows)
    if name == "secret scan":
        assert {r.text for r in got if r.doc_id == 4} == {"a [secret] here"} and {r.text for r in got if r.doc_id == 1} == {None}
    assert stage(spark, d.limit(0), DATA).count() == 0
