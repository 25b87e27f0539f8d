"""Queries over whole tables that have no SQL."""

from citelens import catalog


def test_no_parts_of_tables():
    """No query's SQL takes a part of its table by the rest of an id that a stated query set does not explain."""
    for key in ("M1_resolved", "P23_sentence_windows", "J19_aligned_raters", "J4_title_lookup"):
        assert "% 3 = 0" not in catalog.SQL[key] and "% 10 = 0" not in catalog.SQL[key] and "% 7 = 1" not in catalog.SQL[key] and "user_id <=" not in catalog.SQL[key]
    assert not [k for k in catalog.QUERIES if k.endswith("_all")]


def test_hot_phrases_stay(spark):
    """A phrase of seven documents is found, one of three is not; against every pair of phrases."""
    from citelens.catalog.text import known_phrases

    texts = ["deep neural networks " + w for w in ("a", "b", "c", "d", "e", "f", "g")] + ["rare pair"] * 3 + ["neural x", "neural y"]
    owners = {}
    for i, t in enumerate(texts):
        w = t.split()
        for n in (1, 2, 3):
            for a in range(len(w) - n + 1):
                owners.setdefault(" ".join(w[a : a + n]), set()).add(i)
    has = [(i, p) for p, o in owners.items() if len(o) >= 4 for i in o]
    want = {(i, p) for i, p in has if not any(i == j and p != q and p in q for j, q in has)}
    got = known_phrases(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "count >= 4").collect()
    assert sorted(map(tuple, got)) == sorted(want) and (0, "deep neural networks") in want and (10, "neural") in want
    everything = catalog.QUERIES["P29_phrases"](spark, "/root/testdata/sf0.001")
    assert everything.join(everything.groupBy("chunk").count().where("count > 5"), "chunk", "left_semi").count() > 0


def test_nearest_in_clusters(spark):
    """Every query's neighbours inside its cluster against numpy over all vectors."""
    import numpy as np

    from citelens.plans.topics import clustered, nearest_inside
    from citelens.storage import written

    unit = written(clustered(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS v"), 8), "clusters")
    rows = unit.orderBy("id").collect()
    v = np.array([r.v for r in rows], dtype=np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    got = {}
    for r in nearest_inside(unit, 5).collect():
        got.setdefault(r.q, []).append((r["rank"], r.cand, r.score))
    ids, cluster = np.array([r.id for r in rows]), np.array([r.cluster for r in rows])
    queries = [i for i, r in enumerate(rows) if r.id % 100 == 0]
    assert len(set(cluster.tolist())) == 8 and len(queries) > 3
    for i in queries:
        scores = v @ v[i]
        order = sorted((j for j in range(len(rows)) if j != i and cluster[j] == cluster[i]), key=lambda j: (-scores[j], ids[j]))[:5]
        mine = sorted(got.get(rows[i].id, []))
        assert len(mine) == len(order) and np.allclose([s for _, _, s in mine], [scores[j] for j in order])


def test_topics_keep_scores(spark):
    """The candidates that topics leave have the scores of the ranking, each query has some, and no candidate is left out where all are kept."""
    from citelens.catalog.models import Slice
    from citelens.plans.topics import preselected
    from citelens.storage import Tables

    s = Slice(Tables(spark, "/root/testdata/sf0.001"))
    every = {(r.q, r.cand): r.score for r in s.bow().collect()}
    few = {(r.q, r.cand): r.score for r in preselected(s.bow(), s.qtf, s.ctf, 4, 3).collect()}
    assert few and all(every[k] == x for k, x in few.items()) and max(sum(q == x for q, _ in few) for x in {q for q, _ in few}) <= 3
    assert preselected(s.bow(), s.qtf, s.ctf, 4, 1000).count() == len(every)


def test_nearest_blocks(spark, monkeypatch):
    """Blocks of one query and chunks of a few candidates give what one block gives."""
    from citelens.plans import vectors

    rows = [(i, f"t{k}", float((i * k) % 7 + 1)) for i in range(40) for k in range(1 + i % 5)]
    c = spark.createDataFrame(rows, "cand long, term string, w double")
    q = c.where("cand % 10 = 4").withColumnRenamed("cand", "q")
    one = [tuple(r) for r in vectors.nearest(q, c, 4).orderBy("q", "rank").collect()]
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 1)
    monkeypatch.setattr(vectors, "CHUNK", 3)
    assert [tuple(r) for r in vectors.nearest(q, c, 4).orderBy("q", "rank").collect()] == one and len(one) == 16
    assert vectors.nearest(q.limit(0), c, 4).count() == 0


def test_cells_of_a_range_join(spark):
    """With and without cells the same pairs, once each."""
    from pyspark.sql import functions as F

    from citelens.operators.joins import overlap_join

    a = spark.range(200).selectExpr("id % 2 AS k", "id AS a", "id * 3 % 97 AS lo", "id * 3 % 97 + id % 40 AS hi")
    b = spark.range(150).selectExpr("id % 3 AS k", "id AS b", "id * 5 % 89 AS start", "id * 5 % 89 + id % 25 AS end")
    plain = overlap_join(a, b, ["k"], ("lo", "hi"), ("start", "end")).select("a", "b").collect()
    cells = overlap_join(a, b, ["k"], ("lo", "hi"), ("start", "end"), cell=lambda x: F.floor(x / 10)).select("a", "b").collect()
    assert sorted(plain) == sorted(cells) and len(plain) > 1000
