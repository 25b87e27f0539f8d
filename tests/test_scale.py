"""Steps that have to stay bounded as the tables grow: parts and blocks of a few rows give what brute force gives."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def test_counts_where_a_document_is(spark):
    """Terms are counted without a shuffle or an aggregate of words; texts of one document and source are put together, others never."""
    from citelens.catalog.models import letter_runs
    from citelens.plans import vectors as V

    rows = [(1, "a", "x y x"), (1, "a", "y z"), (1, "b", "x"), (2, None, "z z"), (3, "a", None), (4, "b", "1 2"), (None, "a", "w"), (None, "a", "w v")]
    want = defaultdict(Counter)
    for i, source, text in rows:
        want[i, source].update(letter_runs(text or ""))
    got = V.counted(documents(spark, rows), letter_runs).collect()
    assert sorted(((r.doc_id, r.source, r.n, dict(zip(r.terms, r.tfs))) for r in got), key=str) == sorted(((*k, c.total(), dict(c)) for k, c in want.items() if c), key=str)
    plan = V.counted(documents(spark, rows[2:5]), letter_runs)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan


def test_sums_by_blocks(spark, monkeypatch):
    """Parts of one query and blocks of a few rows: sums, lengths and shared terms as by hand."""
    from citelens.plans import vectors as V
    from citelens.storage import written

    texts = {q: Counter(f"t{(q * k) % 11}" for k in range(1, 2 + q % 6)) for q in range(1, 30)}
    table = [(f"t{i}", f"c{j}", float(i + j)) for i in range(9) for j in range(4) if (i + j) % 3] + [(f"t{i}", None, i / 2) for i in range(10)]
    queries = spark.createDataFrame([(q, list(c), list(c.values())) for q, c in texts.items()], "q long, terms array<string>, tfs array<long>")
    t = written(spark.createDataFrame(table, "term string, cand string, w double").repartition(3), "weights")
    want = {}
    for q, c in texts.items():
        square = sum(tf * tf * w for term, cand, w in table if cand is None and (tf := c[term])) + 2 * sum(x * x for x in c.values())
        for term, cand, w in table:
            if cand and c[term]:
                total = want.get((q, cand), (0, 0))[0] + c[term] * w
                want[q, cand] = total, square
    for name, value in (("PART", 4), ("BLOCK_ROWS", 8), ("EXPANDED", 2)):
        got = {(r.q, r.cand): (r.total, r.square) for r in V.sums(queries, t, 2.0).collect()}
        assert got == want and len(got) > 50
        monkeypatch.setattr(V, name, value)
    assert {(r.q, r.cand): (r.total, r.square) for r in V.sums(queries, t, 2.0).collect()} == want
    shared = {(r.q, r.cand): r.n for r in V.shared_terms(queries, t.where(F.col("cand").isNotNull())).collect()}
    assert shared == {(q, c): sum(1 for term, cand, _ in table if cand == c and texts[q][term]) for q, c in want}


def test_pairs_of_equal_keys(spark, monkeypatch):
    """Blocks of three rows give each pair once; ids that occur twice give their pairs twice, nulls none."""
    from citelens.operators import joins as J

    rows = [(("x", "y", None)[i % 3], i // 2 if i % 5 else i) for i in range(60)] + [("x", None), ("x", 7), ("x", 7)]
    want = sorted((a, b) for k, a in rows for m, b in rows if k and k == m and a is not None and b is not None and a < b)
    df = spark.createDataFrame(rows, "k string, id long")
    monkeypatch.setattr(J, "PAIR_BLOCK", 3)
    monkeypatch.setattr(J, "PAIRS", 50)
    assert sorted(map(tuple, J.equal_pairs(df, "k").collect())) == want
    plan = J.equal_pairs(df, "k")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange RoundRobin") < plan.index("SortMergeJoin" if "SortMergeJoin" in plan else "Join")


def test_references_do_not_meet_all_papers(spark):
    """60,000 references and papers of one title: two names, the most cited of each, the least id on ties. As pairs they would be 3.6 billion."""
    from citelens.plans import matching as M

    rows = spark.range(60_000)
    papers = rows.selectExpr("id AS paper", "'Same old Title' AS title", "id % 1000 AS citations")
    authors = rows.selectExpr("id AS paper", "if(id % 2 = 0, 'Ada Lo', 'Bob') AS author")
    refs = rows.selectExpr("concat('u', id) AS uuid", "if(id % 3 = 0, 'The same old title', 'same old title') AS title", "if(id % 5 = 0, 'by ADA', if(id % 5 = 1, 'by bob', 'nobody')) AS reference")
    got = M.resolve(refs, papers, authors).groupBy("paper").count().collect()
    assert sorted(map(tuple, got)) == [(998, 12_000), (999, 12_000)]


def test_nearest_sets(spark, monkeypatch):
    """The nearest sets against all pairs, in blocks of three queries and matrices of a few cells; sizes from 0, equal sets, labels that are null."""
    import random

    from citelens.plans import vectors as V

    r = random.Random(3)
    q = {i: {r.randrange(12) for _ in range(r.randrange(1, 6))} | ({None} if i % 7 == 0 else set()) for i in range(40)}
    c = {i: {r.randrange(12) for _ in range(r.randrange(1, 9))} | ({None} if i % 6 == 0 else set()) for i in range(300)} | {301: {None}}
    rows = lambda sets, name: spark.createDataFrame([(i, x) for i, own in sets.items() for x in own], f"{name} long, label int")

    def check():
        for f, score in ((V.containment, lambda m, a, b: m / b), (V.jaccard, lambda m, a, b: m / (a + b - m))):
            want = []
            for i, a in q.items():
                met = [(round(score(m, len(a), len(b)), 9), j) for j, b in c.items() if (m := len((a & b) - {None}))]
                want += [(i, j, s) for s, j in sorted(met, key=lambda x: (-x[0], x[1]))[:5]]
            assert sorted(map(tuple, f(rows(q, "q"), rows(c, "cand"), 5).collect())) == sorted(want)

    check()
    monkeypatch.setattr(V, "SETS", 3)
    monkeypatch.setattr(V, "CELLS", 100)
    check()


def test_nearest_sets_leave_pairs_out(spark):
    """20,000 queries against 200,000 candidates, of which the smallest decide: 4 billion pairs are not made."""
    from citelens.plans import vectors as V

    q = spark.range(20_000).selectExpr("id AS q", "explode(array(id % 25, id * 7 % 25, id * 11 % 25)) AS label")
    c = spark.range(200_000).selectExpr("id AS cand", "explode(transform(sequence(id % 25, id % 25 + if(id % 50 < 25, 0, 17)), x -> x % 25)) AS label")
    got = V.containment(q, c, 5)
    assert got.agg(F.count("*"), F.min("score"), F.max("score")).first() == (100_000, 1.0, 1.0)


def test_workers_hold_one_row(spark, monkeypatch):
    """Made rows leave a worker in parts of a few bytes, none lost, with the rows that Spark hands over as one batch."""
    from citelens.sources import files as S

    def made(batch, i):
        for k in range(batch.column(0)[i].as_py() % 4):
            yield batch.column(0)[i].as_py(), "x" * (k * 50)

    rows = spark.range(40).repartition(1)
    want = sorted((i, "x" * (k * 50)) for i in range(40) for k in range(i % 4))
    monkeypatch.setattr(S, "GATHERED", 100)
    assert sorted(map(tuple, S.one_at_a_time(rows, made, "id long, x string").collect())) == want
    monkeypatch.undo()
    assert sorted(map(tuple, S.one_at_a_time(rows, made, "id long, x string").collect())) == want


def test_middle_distance(spark):
    """The window around the middle sentence without lists of sentences in the plan; empty, null and one-letter texts have none."""
    from citelens.functions import spans as S

    texts = {1: "One is. Two is. Three is here. Four.", 2: None, 3: "", 4: "a", 5: "Only one", 6: " \n", 7: "A. B. C."}
    got = S.middle_distance(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 3).collect()
    want = {i: S.sentence_window(x, own[(len(own) - 1) // 2][0] + 1, 3) for i, x in texts.items() if x and (own := S.sentences(x)) and own[(len(own) - 1) // 2][1] > own[(len(own) - 1) // 2][0] + 1}
    assert {r.doc_id: (r.before, r.after) for r in got} == want and set(want) == {1, 5, 7}


def test_nearest_by_rare_terms(spark, monkeypatch):
    """Terms of few queries, which no matrix holds, give what a matrix of all terms gives."""
    from citelens.plans import vectors as V

    rows = [(i, f"t{k}", float((i * k) % 7 + 1)) for i in range(60) for k in range(1 + i % 5)]
    c = spark.createDataFrame(rows, "cand long, term string, w double")
    q = c.where("cand % 10 = 4 OR cand % 10 = 1").withColumnRenamed("cand", "q")
    got = []
    for dense in (1_000, 2, 0):
        monkeypatch.setattr(V, "DENSE", dense)
        got.append([tuple(r) for r in V.nearest(q, c, 4).orderBy("q", "rank").collect()])
    assert got[0] == got[1] == got[2] and len(got[0]) == 48
