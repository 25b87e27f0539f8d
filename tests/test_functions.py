"""Small cases of text functions, splits and metrics."""

import math

from pyspark.sql import functions as F

from citelens.functions import parse, spans
from citelens.functions import text as X
from citelens.operators import hierarchy, ranking
from citelens.plans import matching, metrics
from citelens.sources import contexts, files


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def test_journal_doi(spark):
    assert one(spark, X.journal_doi(F.lit("see Phys. Rev. B 84, 245128"))) == "10.1103/physrevb.84.245128"
    assert one(spark, X.journal_doi(F.lit("in Phys. Rev. Lett. 73 (1994) 3070"))) == "10.1103/physrevlett.73.3070"
    assert one(spark, X.journal_doi(F.lit("a rev mod phys b 80 123"))) == "10.1103/revmodphysb.80.123"
    assert one(spark, X.journal_doi(F.lit("in Phys. Rev. B 84"))) is None
    assert one(spark, X.journal_doi(F.lit("none"))) is None


def test_ids(spark):
    assert one(spark, X.repaired_ids(F.lit("quant-ph/0802.3625"))) == ["quant-ph/0802.3625", "0802.3625"]
    assert one(spark, X.repaired_ids(F.lit("14025167")))[-1] == "1402.5167"
    assert one(spark, X.with_slash(F.lit("hep-th9901001"))) == "hep-th/9901001"
    assert one(spark, X.paper_id(F.lit("x arXiv:1412.3684 y"))) == "1412.3684"
    assert one(spark, X.paper_id(F.lit("http://arxiv.org/abs/1412.3684"))) == "1412.3684"


def test_word_boundaries(spark):
    assert one(spark, X.bag_of_words(F.lit("the CITY has MAINCIT and a REFERENCE, CIT."))) == ["CITY", "has", "REFERENCE"]


def test_word_window():
    marker = "{{cite:01234567-89ab-4cde-8f01-23456789abcd}}"
    text = f", {marker} this is an example {marker}. Baz bam."
    assert text[: spans.window_length(text, 5)].endswith("Baz")
    assert text[-spans.window_length(text, 2, True) :] == "Baz bam."
    assert spans.window_length(text, 0) == 0 and spans.window_length("", 3) == 0
    assert spans.window_length("a b", 9) == 3


def test_sentences():
    text = "As in fig. 3 we see, cf. Smith et al. this. Next one! Last"
    assert [text[a:b] for a, b in spans.sentences(text)] == ["As in fig. 3 we see, cf. Smith et al. this.", "Next one!", "Last"]


def test_sentence_window():
    text = "One is here. Two is cf. this. Three! Four ends"
    at = text.index("this")
    assert spans.sentence_window(text, at, 1) == (at - 13, 5)
    assert spans.sentence_window(text, at, 3) == (at, text.index(" Four") - at)
    assert spans.sentence_window(text, at, 5) == (at, len(text) - at)
    assert spans.sentence_window(text, 0, 1) == (0, 12) and spans.sentence_window("", 0, 3) == (0, 0)
    assert spans.sentence_window(text, len(text), 1) == (9, 0)


def test_metric_example(spark):
    """Truth a, also b to e, list - b - - a - - - c - d e: found at places 2, 5 and 9 of the first ten."""
    listed = [(1, c, i) for i, c in enumerate("-b--a---c-de", 1) if c != "-"]
    listed += [(1, f"none{i}", i) for i, c in enumerate("-b--a---c-de", 1) if c == "-"]
    r = spark.createDataFrame(listed, "q int, cand string, rank int")
    truth = spark.createDataFrame([(1, "a")], "q int, cand string")
    near = spark.createDataFrame([("a", x) for x in "bcde"], "cand string, other string")
    m = {x.k: x for x in metrics.graded(r, truth, near).collect()}
    assert m[10].rr == 1 / 5 and m[4].recall == 0 and m[5].recall == 1
    assert math.isclose(m[10].ap, (1 / 2 + 2 / 5 + 3 / 9) / 3)
    half = math.sqrt(2) - 1
    dcg = half / math.log2(3) + 1 / math.log2(6) + half / math.log2(10)
    assert math.isclose(m[10].ndcg, dcg / (1 + sum(half / math.log2(i + 1) for i in range(2, 6))))
    assert all(0 <= x.ndcg <= 1 for x in m.values())


def test_split(spark):
    rows = [("c", f"d{i}", j) for i in range(5) for j in range(5 - i)] + [("single", "d", 0)]
    out = ranking.greedy_split(spark.createDataFrame(rows, "cited string, citing string, pos int"), "cited", "citing").collect()
    assert {r.citing: r.is_test for r in out} == {"d0": False, "d1": False, "d2": False, "d3": False, "d4": True}
    assert sum(r.n for r in out) == 15


def test_hierarchy(spark):
    e = spark.createDataFrame([("a", "m"), ("a", "n"), ("b", "n"), ("m", "r"), ("n", "s")], "child string, parent string")
    assert {tuple(r) for r in hierarchy.roots(e).where("node = 'a'").collect()} == {("a", "r"), ("a", "s")}
    pairs = spark.createDataFrame([("a", "b"), ("m", "n")], "a string, b string")
    assert {tuple(r) for r in hierarchy.distance(pairs, e).collect()} == {("a", "b", 1), ("m", "n", 6)}


def test_deep_hierarchy(spark):
    """A chain of nine levels keeps its root, and a cycle ends."""
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(9)] + [("x", "y"), ("y", "x"), ("x", "n8")], "child string, parent string")
    got = {tuple(r) for r in hierarchy.roots(e).collect()}
    assert got == {(f"n{i}", "n9") for i in range(10)} | {("x", "n9"), ("y", "n9")}
    assert {r.node: r.depth for r in hierarchy.ancestors(e).where("ancestor = 'n9'").collect()}["n0"] == 9
    labels = spark.createDataFrame([("k", "n0"), ("k", "alone"), ("k", "x"), ("m", "alone")], "k string, label string")
    assert {tuple(r) for r in hierarchy.top_roots(labels, e, "k", "label").collect()} == {("k", "n9", 2), ("m", "alone", 1)}


def test_numbered(spark):
    rows = spark.range(1000).selectExpr("id * 7919 % 1000 AS v", "id % 3 AS w").repartition(7)
    found, n = ranking.numbered(rows, F.col("v"))
    assert n == 1000 and all(r.number == r.v for r in found.collect())
    assert ranking.numbered(rows.limit(0), F.col("v"))[0].count() == 0


def test_jdbc(spark, tmp_path):
    """By the embedded database that Spark comes with, where it is there."""
    import pytest

    url = f"jdbc:derby:{tmp_path}/db"
    try:
        spark.range(100).selectExpr("id AS k", "concat('t', id) AS title").write.format("jdbc").option("url", f"{url};create=true").option("dbtable", "papers").option("driver", "org.apache.derby.iapi.jdbc.AutoloadedDriver").save()
    except Exception as e:
        if "ClassNotFound" not in str(e):
            raise
        pytest.skip("no database driver")
    df = files.read_jdbc(spark, url, "papers", "k", 4, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert df.rdd.getNumPartitions() == 4 and df.count() == 100 and df.where("k < 10").count() == 10


def test_context_lines(spark):
    lines = ["c␞x␟y␞d␞text", "c␞␞d␞text␞f1␟f2", 'c␞␞d␞t␞␞[[1]]␞p␟q␝q', "term"]
    rows = contexts.parse_contexts(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert rows[0].adjacent == ["x", "y"] and rows[0].fos is None
    assert rows[1].adjacent == [] and rows[1].fos == ["f1", "f2"]
    assert rows[2].np_all == ["p", "q"] and rows[2].np_marker == ["q"]
    assert rows[3].text == "term" and rows[3].cited_id is None


def test_archives():
    import pandas as pd

    packed = files.archive_of(pd.DataFrame({"member": ["a.tex", "b.pdf"], "text": ["é", "%PDF-"]}))
    assert files.members("x.tar.gz", packed) == [("a.tex", "é".encode())]
    assert files.decoded("é".encode("latin-1")) == "é"
    assert files.decoded("é→".encode("utf-16")) == "é→" and files.decoded("ab".encode("utf-16-be")) == "ab" and files.decoded(b"") == ""
    assert files.decoded("é".encode() + b"\x81") == "é\ufffd"


def test_resolve(spark):
    refs = spark.createDataFrame([("u1", "A Study of Things", "J. Smith, A study of things"), ("u2", "Extra A Study of Things", "Miller: extra"), ("u3", "Nothing", "x")], "uuid string, title string, reference string")
    papers = spark.createDataFrame([(1, "a study of things", 5), (2, "A Study, of Things", 9)], "paper int, title string, citations int")
    authors = spark.createDataFrame([(1, "j smith"), (2, "b smith"), (2, "k miller")], "paper int, author string")
    assert {tuple(r) for r in matching.resolve(refs, papers, authors).collect()} == {("u1", 2), ("u2", 2)}


def node(idx, head, rel, text, tag="NOUN"):
    return dict(idx=idx, head=head, rel=rel, text=text, tag=tag)


def test_phrases():
    """Names, expressions, compounds with a conjunct, adjectives with an adverb; verbs and numbers make no phrase, placeholders go."""
    tree = [node(1, 4, "amod", "available", "ADJ"), node(2, 1, "advmod", "publicly", "ADV"), node(3, 4, "amod", "large", "ADJ"), node(4, 0, "root", "sets"), node(5, 4, "nummod", "two", "NUM")]
    assert parse.Tree(tree).phrases(tree[3]) == ["publicly available large sets"]
    tree = [node(1, 3, "compound", "word"), node(2, 1, "conj", "sentence"), node(3, 0, "root", "CIT model"), node(4, 3, "name", "X")]
    assert parse.Tree(tree).phrases(tree[2]) == ["word model X", "sentence model X"]
    assert parse.Tree([node(1, 0, "root", "run", "VERB")]).phrases(node(1, 0, "root", "run", "VERB")) == []


def test_claims():
    """From the marker up: its apposition, the nodes on the way, the predicate's other arguments, a clause's own; halving weights; fallback."""
    tree = [node(1, 2, "nsubj", "Paper"), node(2, 0, "root", "shows", "VERB"), node(3, 2, "dobj", "proofs"), node(4, 3, "nmod", "MAINCIT", "PROPN"), node(5, 4, "appos", "theorem"), node(6, 2, "advcl", "using", "VERB"), node(7, 6, "dobj", "logic")]
    whole = [(1.0, f"shows:{x}") for x in ("logic", "paper", "proofs", "theorem")]
    assert parse.claims_by_marker(tree, [2]) == whole
    both = parse.claims_by_marker(tree, [2, 3])
    assert both == [(1.0, "proofs:theorem")] + [(0.5, x) for _, x in whole]
    bare = [n for n in tree if n["idx"] not in (4, 5)]
    assert parse.claims_by_marker(bare, [6]) == [(0.25, f"using:{x}") for x in ("logic", "paper", "proofs")]
    assert parse.claims_by_nouns(bare, [6]) == [(1.0, "using:logic")]
    assert parse.claims_by_nouns(bare, [6], True) == [(1.0, f"using:{x}") for x in ("logic", "paper", "proofs")]
    assert parse.claims_by_marker(tree, []) == [] and parse.claims_by_marker([], [1]) == []
    copula = [node(1, 3, "nsubj", "MAINCIT"), node(2, 3, "cop", "is", "VERB"), node(3, 0, "root", "standard")]
    assert parse.Tree(copula).predicate(copula[2]) == "is"


def test_placed_markers(spark):
    from citelens.operators.contexts import placed_markers

    cit = '<cit><ref target="{}"/></cit>'.format
    texts = spark.createDataFrame([(1, f"a{cit('k')} b{cit('x')}{cit('k')}."), (2, f"c{cit('k')}"), (3, "none"), (4, None)], "doc int, text string")
    keys = spark.createDataFrame([(1, "k", "u1"), (2, "x", "u2"), (2, "x", "u3")], "doc int, key string, uuid string")
    got = {r.doc: (r.text, r.citations, r.dropped) for r in placed_markers(texts, keys, "doc", "text").collect()}
    assert got == {1: ("a{{cite:u1}} b{{cite:u1}}.", 3, 1), 2: ("c", 1, 1), 3: ("none", 0, 0), 4: (None, 0, 0)}


def test_adler32(spark):
    import zlib

    for text in ("", "a", "Wikipedia", "é日本😀" * 50, "x" * 6000):
        assert one(spark, X.adler32(F.lit(text))) == f"{zlib.adler32(text.encode()):x}"
    assert one(spark, X.adler32(F.lit(None).cast("string"))) is None


def test_short_titles_have_no_cap(spark):
    """More short titles than a broadcast of 10,000 rows held, against all pairs; also inside words, of one letter, and in no reference."""
    from citelens.operators.joins import contained_titles

    titles = [(i, f"t{i}x") for i in range(10_400)] + [(20_000, "a"), (20_001, "b c"), (20_002, "qq"), (20_003, "zzz"), (20_004, "t3x t4x")]
    refs = [(1, "at10399xb and t5x"), (2, "t3x t4x t10001x"), (3, "rub cat"), (4, "a"), (5, "")]
    got = contained_titles(spark.createDataFrame(refs, "r long, reference string"), spark.createDataFrame(titles, "k long, title string"), "r", "k").collect()
    assert sorted(map(tuple, got)) == sorted((r, k) for r, x in refs for k, y in titles if y in x)
