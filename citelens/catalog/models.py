"""Ranking models and their metrics. Documents stand for contexts: a source is the cited paper, a document the citing one."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from citelens.catalog.registry import query
from citelens.functions.text import letter_words
from citelens.operators import hierarchy as H
from citelens.operators import ranking as R
from citelens.plans import matching as MA
from citelens.plans import metrics as M
from citelens.plans import vectors as V
from citelens.storage import written

LETTERS, PHRASE_WORDS = re.compile("[a-z]+"), re.compile("[a-zA-Z0-9-]+")

BASE = """WITH tok AS (SELECT doc_id, source, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents),
cnt AS (SELECT source, doc_id, count(*) AS n FROM tok GROUP BY 1, 2),
ord AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY source) AS total, row_number() OVER (PARTITION BY source ORDER BY n DESC, doc_id) AS rn, count(*) OVER (PARTITION BY source) AS m FROM cnt),
sp AS (SELECT source, doc_id, before > floor(total * 0.8) OR rn = m AS is_test FROM ord WHERE m >= 2),
nd AS (SELECT count(DISTINCT doc_id) AS n FROM tok),
df AS (SELECT term, count(DISTINCT doc_id) AS df FROM tok GROUP BY term HAVING count(DISTINCT doc_id) >= 2),
ctf AS (SELECT source AS cand, term, count(*) AS tf FROM tok JOIN sp USING (source, doc_id) WHERE NOT is_test GROUP BY 1, 2),
qtf AS (SELECT doc_id AS q, term, count(*) AS tf FROM tok JOIN sp USING (source, doc_id) WHERE is_test GROUP BY 1, 2),
truth AS (SELECT doc_id AS q, source AS cand FROM sp WHERE is_test),
adj AS (SELECT DISTINCT source AS cand, concat('src', (CAST(substr(source, 4) AS INT) + 1) % 20) AS other FROM documents),
cr AS (SELECT cand, term, tf * ln(CAST(n AS DOUBLE) / df) AS w FROM ctf JOIN df USING (term), nd),
qr AS (SELECT q, term, tf * ln(CAST(n AS DOUBLE) / df) AS w FROM qtf JOIN df USING (term), nd),
cw AS (SELECT cand, term, w / sqrt(sum(w * w) OVER (PARTITION BY cand)) AS w FROM cr),
qw AS (SELECT q, term, w / sqrt(sum(w * w) OVER (PARTITION BY q)) AS w FROM qr),
bow AS (SELECT q, cand, round(sum(a.w * b.w), 9) AS score FROM qw a JOIN cw b USING (term) GROUP BY 1, 2),
cn AS (SELECT cand, term, tf / sqrt(sum(tf * tf) OVER (PARTITION BY cand)) AS w FROM ctf),
qn AS (SELECT q, term, tf / sqrt(sum(tf * tf) OVER (PARTITION BY q)) AS w FROM qtf),
raw AS (SELECT q, cand, round(sum(a.w * b.w), 9) AS score FROM qn a JOIN cn b USING (term) GROUP BY 1, 2),
rk AS (SELECT q, cand, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, cand) AS rank FROM bow)
"""
PER = BASE + """, lst AS (SELECT rk.q, rk.rank, CASE WHEN rk.cand = truth.cand THEN 1.0 WHEN adj.other IS NOT NULL THEN 0.5 ELSE 0.0 END AS rel FROM rk JOIN truth ON rk.q = truth.q LEFT JOIN adj ON adj.cand = truth.cand AND adj.other = rk.cand WHERE rank <= 10),
hit AS (SELECT *, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY q ORDER BY rank) AS hits FROM lst),
na AS (SELECT cand, count(*) AS a FROM adj GROUP BY 1),
qs AS (SELECT q, coalesce(a, 0) AS a FROM truth LEFT JOIN na USING (cand)),
per AS (SELECT qs.q, k, coalesce(sum((pow(2, rel) - 1) / log2(rank + 1)), 0) / (1 + (SELECT coalesce(sum((sqrt(2) - 1) / log2(i + 1)), 0) FROM range(2, 12) r(i) WHERE i <= k AND i <= a + 1)) AS ndcg, coalesce(sum(CASE WHEN rel > 0 THEN hits * 1.0 / rank ELSE 0 END), 0) / greatest(coalesce(sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END), 0), 1) AS ap, coalesce(max(CASE WHEN rel = 1 THEN 1.0 / rank END), 0) AS rr, coalesce(max(CASE WHEN rel = 1 THEN 1.0 END), 0) AS recall FROM qs CROSS JOIN (SELECT unnest(range(1, 11)) AS k) LEFT JOIN hit ON hit.q = qs.q AND hit.rank <= k GROUP BY qs.q, k, a)
"""


def letter_runs(text):
    """What letter_words finds, in Python, of a text in lower case."""
    return LETTERS.findall(text)


def last_words(text):
    """The two and three words before each full stop."""
    found = [PHRASE_WORDS.findall(x) for x in text.split(".")]
    return [" ".join(w[-k:]) for w in found for k in (2, 3) if len(w) >= k]


class Slice:
    """Term counts, split and vectors of the documents. Words are counted once, a row a document, and written: split, frequencies and vectors are read from the counts."""

    def __init__(self, t):
        self.counts = V.counted(t("documents").select("doc_id", "source", F.lower("text").alias("text")), letter_runs)
        order = Window.partitionBy("source").orderBy(F.desc("n"), "doc_id")
        whole = Window.partitionBy("source")
        # The split needs only the documents' sizes.
        placed = self.counts.select("doc_id", "source", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"), F.sum("n").over(whole).alias("a"), F.row_number().over(order).alias("rn"), F.count("*").over(whole).alias("m"))
        self.split = written(placed.where("m >= 2").select("doc_id", "source", ((F.col("b") > F.floor(F.col("a") * 0.8)) | (F.col("rn") == F.col("m"))).alias("is_test")), "split")
        self.df = written(V.unpacked(self.counts.select("terms", "tfs")).groupBy("term").agg(F.count("*").alias("df")).where("df >= 2"), "document-counts")
        self.n = self.counts.agg(F.count("*").alias("n"))
        self.queries, ctf = self.parted(self.counts)
        self.ctf = written(ctf, "source-counts")
        self.qtf = V.unpacked(self.queries)
        self.truth = self.split.where("is_test").select(F.col("doc_id").alias("q"), F.col("source").alias("cand"))
        self.adjacent = t("documents").select(F.col("source").alias("cand"), F.concat(F.lit("src"), (F.substring("source", 4, 9).cast("int") + 1) % 20).alias("other")).distinct()

    def parted(self, counts):
        """Counts (doc_id, source, terms, tfs) of the test documents as queries (q, terms, tfs), and those of the others by source (cand, term, tf)."""
        of = lambda test: counts.join(self.split.where(F.col("is_test") == test).select("doc_id", "source"), ["doc_id", "source"], "left_semi")
        c = V.unpacked(of(False).select(F.col("source").alias("cand"), "terms", "tfs")).groupBy("cand", "term").agg(F.sum("tf").alias("tf"))
        return of(True).select(F.col("doc_id").alias("q"), "terms", "tfs"), c

    def bow(self):
        return V.cosines(self.queries, self.ctf, V.inverse_frequencies(self.df, self.n))

    def raw(self):
        return V.cosines(self.queries, self.ctf)

    def ranking(self):
        return R.ranked(self.bow(), "q", F.col("score"), "cand", 10)


def top(scores, k=5):
    return R.ranked(scores, "q", F.col("score"), "cand", k).select("q", "cand", F.round("score", 6).alias("score"), "rank")


TOP = "SELECT q, cand, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT q, cand, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, cand) AS rank FROM {0}) WHERE rank <= 5"


def flagship(t):
    """contexts, split, TF-IDF cosine, top 10, metrics at each cut-off."""
    s = Slice(t)
    m = M.averaged(M.graded(s.ranking(), s.truth, s.adjacent), ["k"])
    return m.select("k", "queries", *[F.round(c, 4).alias(c) for c in ("ndcg", "ap", "rr", "recall")])


query("R13_metrics", PER + "SELECT CAST(k AS INT) AS k, CAST(count(*) AS BIGINT) AS queries, round(avg(ndcg), 4) AS ndcg, round(avg(ap), 4) AS ap, round(avg(rr), 4) AS rr, round(avg(recall), 4) AS recall FROM per GROUP BY k")(flagship)


@query("A7_tfidf", BASE + "SELECT cand, term, round(w, 6) AS w FROM cw")
def _(t):
    s = Slice(t)
    return V.tfidf(s.ctf, "cand", s.df, s.n).select("cand", "term", F.round("w", 6).alias("w"))


@query("J14_similarity", BASE + "SELECT q, cand, round(score, 6) AS score FROM bow")
def _(t):
    return Slice(t).bow().select("q", "cand", F.round("score", 6).alias("score"))


@query("R1_bow_tfidf", BASE + TOP.format("bow"))
def _(t):
    return top(Slice(t).bow())


@query("R1b_documents", """WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 2), nd AS (SELECT count(DISTINCT doc_id) AS n FROM tf), r AS (SELECT doc_id, term, tf * ln(CAST(n AS DOUBLE) / df) AS w FROM tf JOIN df USING (term), nd),
v AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM r WHERE w > 0), s AS (SELECT a.doc_id AS q, b.doc_id AS cand, round(sum(a.w * b.w), 9) AS score FROM v a JOIN v b USING (term) WHERE a.doc_id % 100 = 0 GROUP BY 1, 2)
SELECT q, cand, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, cand) AS rank FROM s WHERE score > 0) WHERE rank <= 10""")
def _(t):
    """Every document as a candidate: the ten nearest of each document whose id is divisible by 100."""
    tf = V.unpacked(V.counted(t("documents").select("doc_id", F.lit(0).alias("source"), F.lower("text").alias("text")), letter_runs)).select("doc_id", "term", "tf")
    df = tf.groupBy("term").agg(F.count("*").alias("df")).where("df >= 2")
    n = tf.select("doc_id").distinct().agg(F.count("*").alias("n"))
    v = V.tfidf(tf.withColumnRenamed("doc_id", "cand"), "cand", df, n).where("w > 0")
    # Packed once, a row a document, for all blocks of queries.
    packed = written(v.groupBy("cand").agg(F.collect_list("term").alias("terms"), F.collect_list("w").alias("weights")), "vectors")
    asked = packed.where("cand % 100 = 0").select(F.col("cand").alias("q"), F.explode(F.arrays_zip("terms", "weights")).alias("e")).select("q", F.col("e.terms").alias("term"), F.col("e.weights").alias("w"))
    found = V.nearest_packed(asked, packed, 10)
    return found.select("q", "cand", F.round("score", 6).alias("score"), "rank")


@query("R2_bm25", BASE + ", dl AS (SELECT cand, sum(tf) AS dl FROM ctf GROUP BY 1), av AS (SELECT avg(dl) AS avgdl FROM dl), bm AS (SELECT q, cand, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM (SELECT DISTINCT q, term FROM qtf) JOIN ctf USING (term) JOIN dl USING (cand) JOIN df USING (term), av, nd GROUP BY 1, 2) " + TOP.format("bm"))
def _(t):
    s = Slice(t)
    return top(V.bm25(s.queries, s.ctf, s.df, s.n))


@query("R3_raw_counts", BASE + TOP.format("raw"))
def _(t):
    return top(Slice(t).raw())


#: The two and three words before each full stop, as phrases before a marker are found; counts of them are the vectors.
PHRASES = BASE + r""", se AS (SELECT doc_id, source, regexp_split_to_array(trim(regexp_replace(unnest(string_split(text, '.')), '[^a-zA-Z0-9-]+', ' ', 'g')), ' ') AS w FROM documents),
ph AS (SELECT doc_id, source, array_to_string(w[len(w) - k + 1:], ' ') AS term, count(*) AS tf FROM se, range(2, 4) r(k) WHERE len(w) >= k GROUP BY 1, 2, 3),
pq AS (SELECT doc_id AS q, term, tf FROM ph JOIN sp USING (source, doc_id) WHERE is_test), pc AS (SELECT source AS cand, term, sum(tf) AS tf FROM ph JOIN sp USING (source, doc_id) WHERE NOT is_test GROUP BY 1, 2),
pqn AS (SELECT q, term, tf / sqrt(sum(tf * tf) OVER (PARTITION BY q)) AS w FROM pq), pcn AS (SELECT cand, term, tf / sqrt(sum(tf * tf) OVER (PARTITION BY cand)) AS w FROM pc),
pr AS (SELECT q, cand, round(sum(a.w * b.w), 9) AS score FROM pqn a JOIN pcn b USING (term) GROUP BY 1, 2) """


def phrase_vectors(t):
    """The slice, and phrase counts of its queries and candidates."""
    s = Slice(t)
    return s, *s.parted(V.counted(t("documents"), last_words))


@query("R4_applicable", PHRASES + TOP.format("(SELECT * FROM pr WHERE q IN (SELECT q FROM pr GROUP BY q HAVING max(score) > 0))"))
def _(t):
    """The ranking by counts of the phrases before markers, for the queries that it scores anything for."""
    _, q, c = phrase_vectors(t)
    return top(V.applicable(V.cosines(q, c)))


LABELS = "WITH q AS (SELECT DISTINCT l_orderkey AS q, s_nationkey AS label FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_orderkey % 100 = 0), c AS (SELECT DISTINCT l_partkey AS cand, s_nationkey AS label FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), nq AS (SELECT q, count(*) AS n FROM q GROUP BY 1), nc AS (SELECT cand, count(*) AS n FROM c GROUP BY 1), m AS (SELECT q, cand, count(*) AS m FROM q JOIN c USING (label) GROUP BY 1, 2) "


def label_sets(t):
    """The stated query set, orders whose number is divisible by 100, against all parts."""
    rows = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_partkey", F.col("s_nationkey").alias("label"))
    return rows.where("l_orderkey % 100 = 0").select(F.col("l_orderkey").alias("q"), "label").distinct(), rows.select(F.col("l_partkey").alias("cand"), "label").distinct()


@query("R5_containment", LABELS + TOP.format("(SELECT q, cand, round(m * 1.0 / n, 9) AS score FROM m JOIN nc USING (cand))"))
def _(t):
    return top(V.containment(*label_sets(t), 5))


@query("R5b_jaccard", LABELS + TOP.format("(SELECT q, cand, round(m * 1.0 / (nq.n + nc.n - m), 9) AS score FROM m JOIN nc USING (cand) JOIN nq USING (q))"))
def _(t):
    return top(V.jaccard(*label_sets(t), 5))


@query("R6_boosted", BASE + ", dots AS (SELECT q, cand, count(*) AS dot FROM (SELECT q, term FROM qtf WHERE length(term) >= 14) JOIN ctf USING (term) GROUP BY 1, 2), tp AS (SELECT q, max(dot) AS t FROM dots GROUP BY 1) SELECT rk.q, rk.cand, CAST(round(count(*) OVER (PARTITION BY rk.q) - rank + 1 + CASE WHEN t >= 1 AND dot >= t - 1 THEN 1.1 ELSE 0 END, 4) AS DOUBLE) AS points FROM rk LEFT JOIN dots USING (q, cand) LEFT JOIN tp ON tp.q = rk.q")
def _(t):
    s = Slice(t)
    dots = V.shared_terms(s.queries, s.ctf.where(F.length("term") >= 14)).withColumnRenamed("n", "dot")
    return V.boosted(R.ranked(s.bow(), "q", F.col("score"), "cand"), dots).withColumn("points", F.round("points", 4))


@query("R7_combined", BASE + ", co AS (SELECT q, cand, round(coalesce(a.score, 0) * 2 + coalesce(b.score, 0), 9) AS score FROM bow a FULL JOIN raw b USING (q, cand)) " + TOP.format("co"))
def _(t):
    s = Slice(t)
    return top(V.combined(s.bow(), s.raw(), (2.0, 1.0)))


CLAIMS = "WITH b AS (SELECT p_partkey, p_brand, concat('is:', unnest(string_split(lower(p_type), ' '))) AS term FROM part), df AS (SELECT term, count(DISTINCT p_partkey) AS df FROM b GROUP BY 1 HAVING count(DISTINCT p_partkey) >= 2), nd AS (SELECT count(DISTINCT p_partkey) AS n FROM b), cr AS (SELECT p_brand AS cand, term, count(*) * max(ln(CAST(n AS DOUBLE) / df)) AS w FROM b JOIN df USING (term), nd GROUP BY 1, 2), cw AS (SELECT cand, term, w / sqrt(sum(w * w) OVER (PARTITION BY cand)) AS w FROM cr WHERE w > 0), qr AS (SELECT p_partkey AS q, term, count(*) * max(ln(CAST(n AS DOUBLE) / df)) AS w FROM b JOIN df USING (term), nd GROUP BY 1, 2), qw AS (SELECT q, term, w / sqrt(sum(w * w) OVER (PARTITION BY q)) AS w FROM qr WHERE w > 0), s AS (SELECT q, cand, round(sum(a.w * b.w), 9) AS score FROM qw a JOIN cw b USING (term) GROUP BY 1, 2) "


@query("R8_claim_tfidf", CLAIMS + TOP.format("s"))
def _(t):
    b = t("part").select("p_partkey", "p_brand", F.explode(F.split(F.lower("p_type"), " ")).alias("w")).select("p_partkey", "p_brand", F.concat(F.lit("is:"), "w").alias("term"))
    df = V.document_frequencies(b, "p_partkey")
    n = t("part").agg(F.count("*").alias("n"))
    q = V.tfidf(V.frequencies(b.withColumnRenamed("p_partkey", "q"), "q"), "q", df, n).where("w > 0")
    return top(V.products(q, V.tfidf(V.frequencies(b.withColumnRenamed("p_brand", "cand"), "cand"), "cand", df, n).where("w > 0")))


@query("R9_topic_preselect")
def _(t):
    """The candidates of the query's nearest topics first, then the ranking among them."""
    from citelens.plans.topics import preselected

    s = Slice(t)
    return top(preselected(s.bow(), s.qtf, s.ctf, topics=8, keep=10))


@query("R10_clustered")
def _(t):
    """Nearest centroid by cosine, then neighbours inside its cluster."""
    from citelens.plans.topics import clustered_neighbours

    return clustered_neighbours(t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), clusters=8, most=5)


@query("R11_word_vectors")
def _(t):
    from citelens.plans.topics import word_clusters

    return word_clusters(t("documents").where("text IS NOT NULL").select("doc_id", letter_words(F.col("text")).alias("words")), clusters=5)


@query("R12_model_comparison", PHRASES + ", x AS (SELECT truth.q, coalesce(rk.rank, k.n) AS a, coalesce(p2.rank, k.n) AS b, coalesce(best, 0) > 0 AS good FROM truth CROSS JOIN (SELECT count(DISTINCT cand) AS n FROM ctf) k LEFT JOIN rk ON rk.q = truth.q AND rk.cand = truth.cand LEFT JOIN (SELECT q, cand, row_number() OVER (PARTITION BY q ORDER BY score DESC, cand) AS rank FROM pr) p2 ON p2.q = truth.q AND p2.cand = truth.cand LEFT JOIN (SELECT q, max(score) AS best FROM pr GROUP BY 1) m ON m.q = truth.q) SELECT CAST(count(*) FILTER (WHERE good AND a < b) AS BIGINT) AS first_better, CAST(count(*) FILTER (WHERE good AND a > b) AS BIGINT) AS second_better, CAST(count(*) FILTER (WHERE good AND a = b) AS BIGINT) AS equal, CAST(count(*) FILTER (WHERE NOT good) AS BIGINT) AS abstained FROM x")
def _(t):
    """Words against the phrases before markers, which score nothing for some queries."""
    s, q, c = phrase_vectors(t)
    return M.compared(s.bow(), V.cosines(q, c), s.truth, s.ctf)


@query("A21_metric_means", PER + "SELECT CAST(k AS INT) AS k, round(sum(ndcg) / count(*), 4) AS ndcg, CAST(round(sum(recall), 4) AS DOUBLE) AS hits FROM per GROUP BY k")
def _(t):
    s = Slice(t)
    g = M.graded(s.ranking(), s.truth, s.adjacent)
    return g.groupBy("k").agg(F.round(F.sum("ndcg") / F.count("*"), 4).alias("ndcg"), F.round(F.sum("recall"), 4).alias("hits"))


@query("A22_rank_thresholds", BASE + "SELECT CAST(count(*) AS BIGINT) AS queries, CAST(count(*) FILTER (WHERE rank <= 1) AS BIGINT) AS top1, CAST(count(*) FILTER (WHERE rank <= 5) AS BIGINT) AS top5, CAST(count(*) FILTER (WHERE rank <= 10) AS BIGINT) AS top10 FROM truth LEFT JOIN rk USING (q, cand)")
def _(t):
    s = Slice(t)
    return M.first_places(s.ranking(), s.truth)


@query("R15_legacy", BASE + "SELECT round(avg(CASE WHEN rank <= 5 THEN 1.0 / rank ELSE 0 END), 6) AS legacy_map5, round(avg(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS legacy_ndcg5 FROM truth LEFT JOIN rk USING (q, cand)")
def _(t):
    s = Slice(t)
    return M.legacy(s.ranking(), s.truth).select(F.round("legacy_map5", 6).alias("legacy_map5"), F.round("legacy_ndcg5", 6).alias("legacy_ndcg5"))


STUDY = """WITH j AS (SELECT user_id, event_type, CAST(row_number() OVER w AS INT) AS rank, value > 50 AS relevant FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id) QUALIFY row_number() OVER w <= 5),
l AS (SELECT user_id, event_type, count(*) FILTER (WHERE relevant) AS hits, min(rank) FILTER (WHERE relevant) AS best FROM j GROUP BY 1, 2), n AS (SELECT user_id, greatest(max(hits), 1) AS n FROM l GROUP BY 1),
h AS (SELECT user_id, event_type, rank, row_number() OVER (PARTITION BY user_id, event_type ORDER BY rank) AS i FROM j WHERE relevant), s AS (SELECT user_id, event_type, sum(i * 1.0 / rank) / count(*) AS ap, sum(1 / log2(rank + 1)) / sum(1 / log2(i + 1)) AS ndcg FROM h GROUP BY 1, 2),
per AS (SELECT user_id, event_type, hits * 1.0 / n AS recall, coalesce(1.0 / best, 0) AS rr, coalesce(ap, 0) AS ap, coalesce(ndcg, 0) AS ndcg FROM l JOIN n USING (user_id) LEFT JOIN s USING (user_id, event_type)) """
METRICS = ("recall", "rr", "ap", "ndcg")


def study(t):
    """A user stands for an item, a type of event for a model, its first five events for the judged list."""
    rank = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    judged = t("events").select("user_id", "event_type", rank.alias("rank"), (F.col("value") > 50).alias("relevant")).where("rank <= 5")
    return M.binary_study(judged, ["user_id"], "event_type")


@query("R14_study_metrics", STUDY + f"SELECT user_id, event_type, {', '.join(f'CAST(round({m}, 6) AS DOUBLE) AS {m}' for m in METRICS)} FROM per")
def _(t):
    return study(t).select("user_id", "event_type", *[F.round(m, 6).alias(m) for m in METRICS])


@query("A31_study_means", STUDY + f"SELECT event_type, CAST(count(*) AS BIGINT) AS items, {', '.join(f'CAST(round(avg({m}), 6) AS DOUBLE) AS {m}' for m in METRICS)} FROM per GROUP BY 1")
def _(t):
    return study(t).groupBy("event_type").agg(F.count("*").alias("items"), *[F.round(F.avg(m), 6).alias(m) for m in METRICS])


@query("R16_similar_to_one", BASE.replace("rk AS", "one AS (SELECT min(q) AS q FROM qw), rk AS") + "SELECT cand, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM rk JOIN one USING (q) WHERE rank <= 11")
def _(t):
    s = Slice(t)
    qw = V.tfidf(s.qtf, "q", s.df, s.n)
    one = qw.join(qw.agg(F.min("q").alias("q")), "q", "left_semi")
    return R.ranked(V.products(one, V.tfidf(s.ctf, "cand", s.df, s.n)), "q", F.col("score"), "cand", 11).select("cand", F.round("score", 6).alias("score"), "rank")


@query("R18_shared_terms", BASE + "SELECT q, cand, CAST(count(*) AS BIGINT) AS shared FROM qtf JOIN ctf USING (term) GROUP BY 1, 2")
def _(t):
    s = Slice(t)
    return V.shared_terms(s.queries, s.ctf).withColumnRenamed("n", "shared")


@query("R19_wilson", "WITH c AS (SELECT CAST(count(*) FILTER (WHERE quality = 1) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM labels WHERE quality IS NOT NULL) SELECT round((k / n + 3.8416 / (2 * n) - 1.96 * sqrt((k / n * (1 - k / n) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n), 6) AS low, round((k / n + 3.8416 / (2 * n) + 1.96 * sqrt((k / n * (1 - k / n) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n), 6) AS high FROM c")
def _(t):
    from citelens.functions.numbers import wilson

    c = t("labels").where("quality IS NOT NULL").agg(F.count_if(F.col("quality") == 1).alias("k"), F.count("*").alias("n"))
    low, high = wilson(F.col("k"), F.col("n"), 1.96)
    return c.select(F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("R20_match_quality", "SELECT CAST(count(*) FILTER (WHERE o_custkey % 10 < 7) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE o_custkey % 10 IN (7, 8)) AS BIGINT) AS fp, CAST(count(*) FILTER (WHERE o_custkey % 10 = 9) AS BIGINT) AS fn FROM orders")
def _(t):
    rows = t("orders").select(F.col("o_orderkey").alias("uuid"), F.col("o_custkey").alias("paper"))
    guess = rows.where("paper % 10 < 9").withColumn("paper", F.when(F.col("paper") % 10 < 7, F.col("paper")).otherwise(-1))
    return MA.quality(rows, guess)


@query("M1_resolved", "WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT uuid, paper FROM (SELECT a.p_partkey AS uuid, b.p_partkey AS paper, row_number() OVER (PARTITION BY a.p_partkey ORDER BY coalesce(n, 0) DESC, b.p_partkey) AS rn FROM part a JOIN part b ON lower(trim(regexp_replace(regexp_replace(a.p_name, '[^a-zA-Z0-9_]', ' ', 'g'), '\\s+', ' ', 'g'))) = lower(trim(regexp_replace(regexp_replace(b.p_name, '[^a-zA-Z0-9_]', ' ', 'g'), '\\s+', ' ', 'g'))) LEFT JOIN c ON l_partkey = b.p_partkey WHERE contains(lower(regexp_replace(a.p_brand, '[^a-zA-Z0-9_]', ' ', 'g')), split_part(lower(regexp_replace(b.p_brand, '[^a-zA-Z0-9_]', ' ', 'g')), ' ', 1))) WHERE rn = 1")
def _(t):
    """Every part as a reference, against all parts."""
    n = t("lineitem").groupBy(F.col("l_partkey").alias("paper")).agg(F.count("*").alias("citations"))
    papers = t("part").select(F.col("p_partkey").alias("paper"), F.col("p_name").alias("title")).join(n, "paper", "left").withColumn("citations", F.coalesce("citations", F.lit(0)))
    authors = t("part").select(F.col("p_partkey").alias("paper"), F.col("p_brand").alias("author"))
    return MA.resolve(t("part").select(F.col("p_partkey").alias("uuid"), F.col("p_name").alias("title"), F.col("p_brand").alias("reference")), papers, authors)


# hierarchy-

EDGES = "WITH RECURSIVE e AS (SELECT concat('s', s_suppkey) AS child, concat('n', s_nationkey) AS parent FROM supplier UNION ALL SELECT concat('s', s_suppkey), concat('n', (s_nationkey + 7) % 25) FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey) FROM nation), nodes AS (SELECT child AS node FROM e UNION SELECT parent FROM e), up(node, ancestor, depth) AS (SELECT node, node, 0 FROM nodes UNION SELECT up.node, e.parent, depth + 1 FROM up JOIN e ON up.ancestor = e.child), anc AS (SELECT node, ancestor, min(depth) AS depth FROM up GROUP BY 1, 2) "


def edges(t):
    s = t("supplier")
    own = s.select(F.concat(F.lit("s"), "s_suppkey").alias("child"), F.concat(F.lit("n"), "s_nationkey").alias("parent"))
    more = s.where("s_suppkey % 3 = 0").select(F.concat(F.lit("s"), "s_suppkey").alias("child"), F.concat(F.lit("n"), (F.col("s_nationkey") + 7) % 25).alias("parent"))
    return own.unionByName(more).unionByName(t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent")))


@query("G1_parents", EDGES + "SELECT child, string_agg(DISTINCT parent, ',' ORDER BY parent) AS parents FROM e GROUP BY child")
def _(t):
    return H.parents(edges(t)).select("child", F.array_join("parents", ",").alias("parents"))


@query("G2_roots", EDGES + "SELECT node, ancestor AS root FROM anc WHERE ancestor NOT IN (SELECT child FROM e)")
def _(t):
    return H.roots(edges(t))


@query("G3_match_scores", EDGES + "SELECT a.node, b.node AS target, CAST(round(coalesce(1 - 0.2 * depth, 0), 4) AS DOUBLE) AS score FROM nodes a JOIN nodes b ON a.node LIKE 's%' AND b.node LIKE 'r%' LEFT JOIN anc ON anc.node = a.node AND anc.ancestor = b.node AND depth <= 5")
def _(t):
    e = edges(t)
    pairs = e.where("child LIKE 's%'").select(F.col("child").alias("node")).distinct().crossJoin(F.broadcast(t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("target"))))
    return H.match_score(pairs, e).withColumn("score", F.round("score", 4))


@query("G4_distances", EDGES + ", p AS (SELECT concat('s', s_suppkey) AS a, concat('s', s_suppkey % 50 + 1) AS b FROM supplier) SELECT p.a, p.b, CAST(coalesce(min(greatest(x.depth, y.depth)), 6) AS INT) AS distance FROM p LEFT JOIN (anc x JOIN anc y ON x.ancestor = y.ancestor AND x.depth <= 5 AND y.depth <= 5) ON x.node = p.a AND y.node = p.b GROUP BY 1, 2")
def _(t):
    pairs = t("supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("a"), F.concat(F.lit("s"), F.col("s_suppkey") % 50 + 1).alias("b"))
    return H.distance(pairs, edges(t))


@query("G5_expanded", EDGES + "SELECT l_partkey AS k, concat('s', l_suppkey) AS node FROM lineitem UNION SELECT l_partkey, parent FROM lineitem JOIN e ON child = concat('s', l_suppkey)")
def _(t):
    return H.expanded(t("lineitem").select(F.col("l_partkey").alias("k"), F.concat(F.lit("s"), "l_suppkey").alias("node")), edges(t), "k", "node")


@query("G6_score_sums", EDGES + "SELECT ancestor AS target, CAST(round(sum(1 - 0.2 * depth), 4) AS DOUBLE) AS score FROM anc WHERE node LIKE 's%' AND depth <= 5 GROUP BY 1")
def _(t):
    up = H.ancestors(edges(t), 5).where("node LIKE 's%'")
    return up.groupBy(F.col("ancestor").alias("target")).agg(F.round(F.sum(1 - 0.2 * F.col("depth")), 4).alias("score"))


@query("G7_tree_walk", EDGES + "SELECT node, CAST(max(depth) AS INT) AS depth FROM anc GROUP BY node")
def _(t):
    return H.ancestors(edges(t)).groupBy("node").agg(F.max("depth").alias("depth"))


@query("G8_flow", "WITH p AS (SELECT o_orderpriority AS a, l_returnflag AS b, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) SELECT CAST(dense_rank() OVER (ORDER BY a) - 1 AS INT) AS source, CAST(dense_rank() OVER (ORDER BY b) - 1 AS INT) AS target, CAST(n AS BIGINT) AS n FROM p")
def _(t):
    p = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_orderpriority").alias("a"), F.col("l_returnflag").alias("b")).agg(F.count("*").alias("n"))
    return p.select((F.dense_rank().over(Window.orderBy("a")) - 1).alias("source"), (F.dense_rank().over(Window.orderBy("b")) - 1).alias("target"), "n")


@query("A40_root_counts", EDGES + "SELECT r_name AS root, CAST(count(*) AS BIGINT) AS n FROM lineitem JOIN anc ON node = concat('s', l_suppkey) JOIN region ON ancestor = concat('r', r_regionkey) GROUP BY 1")
def _(t):
    root = H.roots(edges(t)).join(t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("root"), "r_name"), "root")
    return t("lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("node")).join(root, "node").groupBy(F.col("r_name").alias("root")).agg(F.count("*").alias("n"))
