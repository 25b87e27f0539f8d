"""Joins, aggregates, windows and sets over the tables; line items stand for contexts: part is cited, order is citing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from citelens.catalog.registry import query
from citelens.operators import aggregates as A
from citelens.operators import joins as J
from citelens.operators import ranking as R


def cites(t):
    return t("lineitem").select(F.col("l_partkey").alias("cited"), F.col("l_orderkey").alias("citing"), F.col("l_linenumber").alias("pos"), "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")


def i64(c):
    return F.col(c).cast("long") if isinstance(c, str) else c.cast("long")


# joins

@query("J1_inner", "SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey")
def _(t):
    return t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_name")


@query("J2_often_cited", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(*) > 30)")
def _(t):
    return J.with_at_least(t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey", 31).select("l_orderkey", "l_linenumber", "l_partkey")


@query("J3_non_null", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem)")
def _(t):
    return t("lineitem").where("l_partkey IS NOT NULL").select("l_orderkey", "l_linenumber")


WHOLE = "concat(repeat('the ', p_partkey % 3), p_name, ' ', lower(p_type), repeat(' b', p_partkey % 4))"
TITLES = f"WITH w AS (SELECT p_partkey AS q, string_split({WHOLE}, ' ') AS w FROM part), s AS (SELECT q, a + b AS dropped, a, array_to_string(w[a + 1:len(w) - b], ' ') AS title FROM w, range(0, 3) x(a), range(0, 3) y(b) WHERE len(w) > a + b), k AS (SELECT concat(p_name, ' ', lower(p_type)) AS title, min(p_partkey) AS paper FROM part GROUP BY 1)"


@query("J4_title_lookup", TITLES + " SELECT q, paper, dropped FROM (SELECT q, paper, dropped, row_number() OVER (PARTITION BY q ORDER BY dropped, a) AS rn FROM s JOIN k USING (title)) WHERE rn = 1")
def _(t):
    """Titles with up to two words before and three after them, against those of all parts; three words too many are not found."""
    from citelens.functions.text import shifted_titles

    known = t("part").groupBy(F.expr("concat(p_name, ' ', lower(p_type))").alias("title")).agg(F.min("p_partkey").alias("paper"))
    whole = F.expr("concat(repeat('the ', CAST(p_partkey % 3 AS INT)), p_name, ' ', lower(p_type), repeat(' b', CAST(p_partkey % 4 AS INT)))")
    guesses = t("part").select(F.col("p_partkey").alias("q"), F.explode(shifted_titles(whole)).alias("g")).select("q", "g.*")
    best = J.best_candidate(guesses.join(known, "title"), ["q"], [F.col("dropped"), F.col("left")])
    return best.select("q", "paper", F.col("dropped").cast("long").alias("dropped"))


@query("J5_same_title", "SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_partkey < b.p_partkey")
def _(t):
    return J.equal_pairs(t("part").select("p_name", F.col("p_partkey").alias("id")), "p_name")


@query("J6_author_filter", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE contains(lower(concat(s_name, ' ', n_name)), lower(n_name)) AND length(n_name) > 1")
def _(t):
    from citelens.plans.matching import author_named

    refs = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    refs = refs.select("l_orderkey", "l_linenumber", F.col("s_suppkey").alias("paper"), F.lower(F.concat_ws(" ", "s_name", "n_name")).alias("reference"))
    authors = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("paper"), F.lower("n_name").alias("author"))
    return author_named(refs, authors, ["l_orderkey", "l_linenumber", "paper"]).select("l_orderkey", "l_linenumber").distinct()


@query("J7_most_cited", "WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey) SELECT p_name, p_partkey FROM (SELECT p_name, p_partkey, row_number() OVER (PARTITION BY p_name ORDER BY coalesce(n, 0) DESC, p_partkey) AS rn FROM part LEFT JOIN c ON p_partkey = l_partkey) WHERE rn = 1")
def _(t):
    n = t("lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    found = t("part").join(n, F.col("p_partkey") == F.col("l_partkey"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return J.best_candidate(found, ["p_name"], [F.desc("n"), F.col("p_partkey")]).select("p_name", "p_partkey")


@query("J8_named_levels", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <= 2")
def _(t):
    return t("nation").join(t("region").where("r_regionkey <= 2"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("J9_lookup_default", "SELECT l_orderkey, l_linenumber, coalesce(p_brand, 'other') AS brand FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 25) ON l_partkey = p_partkey")
def _(t):
    dim = t("part").where("p_size < 25").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    return J.looked_up(t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), dim, "l_partkey", "brand").select("l_orderkey", "l_linenumber", "brand")


@query("J10_with_text", "SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE text IS NOT NULL)")
def _(t):
    return t("labels").join(t("documents").where("text IS NOT NULL").select("doc_id"), "doc_id", "left_semi").select("doc_id", "quality")


@query("J11_overlap", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND b.ts <= a.ts + INTERVAL 1 HOUR AND b.ts >= a.ts - INTERVAL 1 HOUR")
def _(t):
    a = t("events").select("user_id", F.col("event_id").alias("a"), F.expr("ts - INTERVAL 1 HOUR").alias("lo"), F.expr("ts + INTERVAL 1 HOUR").alias("hi"))
    b = t("events").select("user_id", F.col("event_id").alias("b"), F.col("ts").alias("start"), F.col("ts").alias("end"))
    hour = lambda x: F.floor(F.unix_micros(x.cast("timestamp")) / 3_600_000_000)
    return J.overlap_join(a, b, ["user_id"], ("lo", "hi"), ("start", "end"), cell=hour).where("a < b").select("a", "b")


@query("J12_nearest_before", "SELECT l_orderkey, l_linenumber, arg_max(s, row(place, s)) AS l_suppkey FROM (SELECT a.l_orderkey, a.l_linenumber, b.l_linenumber AS place, b.l_suppkey AS s FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber < a.l_linenumber AND a.l_linenumber - b.l_linenumber <= 3) GROUP BY 1, 2")
def _(t):
    near = J.nearest_before(t("lineitem"), ["l_orderkey"], "l_linenumber", "l_suppkey", 3)
    return near.where("l_suppkey_before IS NOT NULL").select("l_orderkey", "l_linenumber", F.col("l_suppkey_before").alias("l_suppkey")).distinct()


@query("J13_not_done", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def _(t):
    done = t("lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.without_done(t("orders").select("o_orderkey"), done, ["o_orderkey"])


@query("J15_span_pairs", "SELECT a.l_orderkey, a.l_linenumber AS a, b.l_linenumber AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <> b.l_linenumber")
def _(t):
    a = t("lineitem").select("l_orderkey", F.col("l_linenumber").alias("a"))
    return a.join(t("lineitem").select("l_orderkey", F.col("l_linenumber").alias("b")), "l_orderkey").where("a <> b")


@query("J16_export_chain", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10 AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')) AND l_orderkey IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING')")
def _(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    returned = rows.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    parts = t("part").where("p_size > 10").join(returned, "p_partkey", "left_semi").select(F.col("p_partkey").alias("l_partkey"))
    orders = t("orders").join(t("customer").where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    return rows.join(parts, "l_partkey", "left_semi").join(orders, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("J17_star", "SELECT l_orderkey, l_linenumber, p_brand, year(o_orderdate) AS citing_year FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_brand IN (SELECT p_brand FROM part GROUP BY p_brand HAVING count(*) >= 50)")
def _(t):
    star = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    brands = t("part").groupBy("p_brand").count().where("count >= 50").select("p_brand")
    return star.join(brands, "p_brand", "left_semi").select("l_orderkey", "l_linenumber", "p_brand", F.year("o_orderdate").cast("long").alias("citing_year"))


@query("J18_ever_adjacent", "SELECT a.l_partkey AS cited, string_agg(DISTINCT CAST(b.l_partkey AS VARCHAR), ',' ORDER BY CAST(b.l_partkey AS VARCHAR)) AS adjacent FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND abs(a.l_linenumber - b.l_linenumber) = 1 GROUP BY a.l_partkey")
def _(t):
    """Parts next to each other in any order: one pass over the orders, by ranges of the line number."""
    order = Window.partitionBy("citing").orderBy("pos")
    beside = lambda at: F.collect_set("cited").over(order.rangeBetween(at, at))
    near = cites(t).select("cited", F.concat(beside(-1), beside(1)).alias("others")).select("cited", F.explode("others").alias("other")).distinct()
    return near.groupBy("cited").agg(F.array_join(F.array_sort(F.collect_list(F.col("other").cast("string"))), ",").alias("adjacent"))


ITEM = "concat(event_type, '-', CAST(floor(event_id / 8) AS BIGINT))"


@query("J19_aligned_raters", f"WITH e AS (SELECT DISTINCT user_id, {ITEM} AS item FROM events) SELECT a.user_id AS a, b.user_id AS b, CAST(count(*) AS BIGINT) AS n FROM e a JOIN e b ON a.item = b.item AND a.user_id < b.user_id GROUP BY 1, 2")
def _(t):
    """Pairs of users by the items that both have judged; an item is judged by eight users at most, so pairs grow with the items."""
    e = t("events").select("user_id", F.expr(ITEM).alias("item")).distinct()
    both = e.withColumnRenamed("user_id", "a").join(e.withColumnRenamed("user_id", "b"), "item").where("a < b")
    return both.groupBy("a", "b").agg(F.count("*").alias("n"))


@query("J20_first_match", "SELECT p_partkey, p_name FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) ORDER BY p_partkey LIMIT 1")
def _(t):
    least = t("part").agg(F.min("p_brand").alias("p_brand"))
    return t("part").join(least, "p_brand", "left_semi").orderBy("p_partkey").limit(1).select("p_partkey", "p_name")


# aggregates

@query("A1_contexts_by_cited", "SELECT l_partkey AS cited, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS citing, min(l_orderkey) AS first, max(l_orderkey) AS last, CAST(sum(l_linenumber) AS BIGINT) AS words FROM lineitem GROUP BY l_partkey")
def _(t):
    """A cited paper's contexts as one group: their number and bounds, as sums that are made before the shuffle; no list of them is."""
    per = cites(t).groupBy("cited", "citing").agg(F.count("*").alias("n"), F.sum("pos").alias("words"))
    return per.groupBy("cited").agg(F.sum("n").alias("n"), F.count("*").alias("citing"), F.min("citing").alias("first"), F.max("citing").alias("last"), F.sum("words").alias("words"))


@query("A2_nested_groups", "SELECT l_partkey AS cited, l_orderkey AS citing, min(l_linenumber) AS first, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2")
def _(t):
    return cites(t).groupBy("cited", "citing").agg(F.min("pos").alias("first"), F.count("*").alias("n"))


@query("A3_enough_contexts", "SELECT l_partkey AS cited, CAST(count(*) AS BIGINT) AS contexts, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS docs FROM lineitem GROUP BY 1 HAVING count(*) >= 25 AND count(DISTINCT l_orderkey) >= 25")
def _(t):
    return cites(t).groupBy("cited").agg(F.count("*").alias("contexts"), F.count_distinct("citing").alias("docs")).where("contexts >= 25 AND docs >= 25")


TOKENS = "(SELECT doc_id, source, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents)"


def tokens(t):
    from citelens.functions.text import letter_words

    return t("documents").select(F.col("doc_id").alias("doc"), "source", F.explode(letter_words(F.col("text"))).alias("term"))


@query("A4_vocabulary", f"SELECT term, CAST(count(*) AS BIGINT) AS cf, CAST(count(DISTINCT doc_id) AS BIGINT) AS df FROM {TOKENS} GROUP BY term HAVING count(DISTINCT doc_id) > 1")
def _(t):
    return A.term_statistics(tokens(t)).where("df > 1").select("term", "cf", "df")


@query("A5_term_frequencies", f"SELECT source, term, CAST(count(*) AS BIGINT) AS tf FROM {TOKENS} GROUP BY 1, 2")
def _(t):
    return tokens(t).groupBy("source", "term").agg(F.count("*").alias("tf"))


@query("A6_weighted_terms", f"SELECT source, term, round(CAST(sum(1.0 / (1 + doc_id % 3)) AS DOUBLE), 4) AS weight FROM {TOKENS} GROUP BY 1, 2")
def _(t):
    return tokens(t).groupBy("source", "term").agg(F.round(F.sum(1 / (1 + F.col("doc") % 3)), 4).alias("weight"))


@query("A8_average_idf", f"WITH df AS (SELECT term, count(DISTINCT doc_id) AS df FROM {TOKENS} GROUP BY term) SELECT round(avg(ln((SELECT count(*) FROM documents)::DOUBLE / df)), 6) AS average FROM df")
def _(t):
    n = t("documents").agg(F.count("*").alias("n"))
    return A.term_statistics(tokens(t)).crossJoin(n).agg(F.round(F.avg(F.log(F.col("n") / F.col("df"))), 6).alias("average"))


@query("A9_distinct_sets", "SELECT CAST(count(DISTINCT l_partkey) AS BIGINT) AS cited, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS citing, CAST(count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_partkey END) AS BIGINT) AS returned FROM lineitem")
def _(t):
    return cites(t).agg(F.count_distinct("cited").alias("cited"), F.count_distinct("citing").alias("citing"), F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("cited"))).alias("returned"))


@query("A10_class_counters", "SELECT l_linestatus, CAST(count(*) FILTER (WHERE l_returnflag = 'A') AS BIGINT) AS a, CAST(count(*) FILTER (WHERE l_returnflag = 'N') AS BIGINT) AS n, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS r FROM lineitem GROUP BY 1")
def _(t):
    return t("lineitem").groupBy("l_linestatus").agg(*[F.count_if(F.col("l_returnflag") == x.upper()).alias(x) for x in "anr"])


@query("A11_pair_counts", "SELECT c_mktsegment, p_brand, CAST(count(*) AS BIGINT) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def _(t):
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("c_mktsegment", "p_brand").agg(F.count("*").alias("n"))


@query("A12_count_of_counts", "SELECT size, CAST(count(*) AS BIGINT) AS n FROM (SELECT l_partkey, count(*) AS size FROM lineitem GROUP BY 1) WHERE size BETWEEN 2 AND 40 GROUP BY size")
def _(t):
    return A.count_of_counts(t("lineitem"), "l_partkey").where("size BETWEEN 2 AND 40")


@query("A13_histogram", "WITH b AS (SELECT CAST(least(floor((l_quantity - 1) / 4.9), 9) AS INT) AS bin FROM lineitem WHERE l_quantity BETWEEN 1 AND 50) SELECT bin, CAST(count(*) AS BIGINT) AS n, round(count(*) * 1.0 / (SELECT count(*) FROM b), 6) AS share FROM b GROUP BY bin")
def _(t):
    return A.histogram(t("lineitem"), F.col("l_quantity"), 1.0, 50.0, 10).withColumn("share", F.round("share", 6))


@query("A14_moments", "SELECT min(l_quantity) AS least, max(l_quantity) AS most, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS deviation FROM lineitem")
def _(t):
    q = "l_quantity"
    return t("lineitem").agg(F.min(q).alias("least"), F.max(q).alias("most"), F.round(F.avg(q), 6).alias("mean"), F.round(F.stddev_pop(q), 6).alias("deviation"))


@query("A15_outlier_cut", "SELECT o_orderkey FROM orders WHERE o_totalprice <= 2 * (SELECT stddev_pop(o_totalprice) FROM orders)")
def _(t):
    s = t("orders").agg(F.stddev_pop("o_totalprice").alias("s"))
    return t("orders").crossJoin(F.broadcast(s)).where("o_totalprice <= 2 * s").select("o_orderkey")


@query("A16_row_shares", "SELECT l_returnflag, l_linenumber, round(n * 1.0 / sum(n) OVER (PARTITION BY l_returnflag), 6) AS share FROM (SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)")
def _(t):
    n = t("lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.count("*").alias("n"))
    return n.select("l_returnflag", "l_linenumber", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("l_returnflag")), 6).alias("share"))


@query("A17_grid", "SELECT CAST(least(floor((l_quantity - 1) / 0.98), 49) AS INT) AS bx, CAST(least(floor(l_discount / 0.002), 49) AS INT) AS by, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_quantity BETWEEN 1 AND 50 AND l_discount BETWEEN 0 AND 0.1 GROUP BY 1, 2")
def _(t):
    return A.grid(t("lineitem"), F.col("l_quantity"), F.col("l_discount"), (1.0, 50.0, 50), (0.0, 0.1, 50))


PATTERNS = "(SELECT conv_id, turn, concat_ws('¦', coalesce(lag(role, 1) OVER w, '<EOS>'), role, coalesce(lead(role, 1) OVER w, '<EOS>')) AS pattern, length(text) % 3 = 0 AS own FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))"


def patterns(t):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    p = F.concat_ws("¦", F.lag("role", 1, "<EOS>").over(w), "role", F.lead("role", 1, "<EOS>").over(w))
    return t("conversations").select("conv_id", "turn", p.alias("pattern"), (F.length("text") % 3 == 0).alias("own"))


@query("A18_pattern_counts", f"SELECT pattern, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE own) AS BIGINT) AS own FROM {PATTERNS} GROUP BY pattern")
def _(t):
    return patterns(t).groupBy("pattern").agg(F.count("*").alias("n"), F.count_if("own").alias("own"))


@query("A19_conditional", f"WITH p AS (SELECT pattern, count(*) AS n, count(*) FILTER (WHERE own) AS own FROM {PATTERNS} GROUP BY pattern) SELECT pattern, round(own * 1.0 / n, 6) AS p FROM p WHERE n >= 5 AND own > 0 AND NOT starts_with(pattern, '<EOS>¦')")
def _(t):
    n = patterns(t).groupBy("pattern").agg(F.count("*").alias("n"))
    own = patterns(t).where("own").groupBy("pattern").agg(F.count("*").alias("n"))
    return A.conditional_probability(n, own, 5).withColumn("p", F.round("p", 6))


@query("A20_positional", "SELECT s AS shift, CAST(count(*) FILTER (WHERE b.role = 'user') AS BIGINT) AS users, CAST(count(*) FILTER (WHERE b.role = 'assistant') AS BIGINT) AS assistants FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS at FROM conversations) a CROSS JOIN (SELECT unnest(range(-5, 6)) AS s) JOIN (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS at FROM conversations) b ON a.conv_id = b.conv_id AND b.at = a.at + s GROUP BY s")
def _(t):
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = t("conversations").select("conv_id", "role", at.alias("at"))
    moved = rows.select("conv_id", "at", F.explode(F.sequence(F.lit(-5), F.lit(5))).alias("shift")).select("conv_id", "shift", (F.col("at") + F.col("shift")).alias("at"))
    j = moved.join(rows, ["conv_id", "at"])
    return j.groupBy(F.col("shift").cast("long").alias("shift")).agg(F.count_if(F.col("role") == "user").alias("users"), F.count_if(F.col("role") == "assistant").alias("assistants"))


@query("A23_top_votes", "WITH RECURSIVE e AS (SELECT concat('s', s_suppkey) AS child, concat('n', s_nationkey) AS parent FROM supplier UNION SELECT concat('s', s_suppkey), concat('n', (s_nationkey + 7) % 25) FROM supplier WHERE s_suppkey % 3 = 0 UNION SELECT concat('n', n_nationkey), concat('r', n_regionkey) FROM nation UNION SELECT concat('r', r_regionkey), concat('w', r_regionkey % 2) FROM region), up(node, ancestor) AS (SELECT child, child FROM e UNION SELECT up.node, e.parent FROM up JOIN e ON up.ancestor = e.child), v AS (SELECT l_partkey, ancestor AS root, count(*) AS n FROM lineitem JOIN up ON node = concat('s', l_suppkey) WHERE ancestor NOT IN (SELECT child FROM e) GROUP BY 1, 2) SELECT l_partkey, root, CAST(n AS BIGINT) AS n FROM (SELECT *, rank() OVER (PARTITION BY l_partkey ORDER BY n DESC) AS r FROM v) WHERE r = 1")
def _(t):
    """Suppliers as labels of parts, rolled up through nations, some suppliers having two, and regions to two roots."""
    from citelens.catalog.models import edges
    from citelens.operators.hierarchy import top_roots

    above = t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("child"), F.concat(F.lit("w"), F.col("r_regionkey") % 2).alias("parent"))
    labels = t("lineitem").select("l_partkey", F.concat(F.lit("s"), "l_suppkey").alias("node"))
    return top_roots(labels, edges(t).unionByName(above), "l_partkey", "node")


@query("A24_accuracy", "WITH a AS (SELECT l_partkey, list(DISTINCT l_returnflag) AS f, list(DISTINCT l_linestatus) AS s, list(DISTINCT CASE WHEN l_quantity > 40 THEN l_returnflag END) AS g FROM lineitem GROUP BY 1) SELECT round(avg(CASE WHEN len(list_intersect(f, list_filter(g, lambda x: x IS NOT NULL))) > 0 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM a")
def _(t):
    a = t("lineitem").groupBy("l_partkey").agg(F.collect_set("l_returnflag").alias("f"), F.collect_set(F.when(F.col("l_quantity") > 40, F.col("l_returnflag"))).alias("g"))
    return a.agg(F.round(F.avg(F.arrays_overlap("f", "g").cast("double")), 6).alias("accuracy"))


@query("A25_stepped_counts", "SELECT step, CAST(count(*) FILTER (WHERE 1 - l_discount * 8 >= step - 0.000001) AS BIGINT) AS n, CAST(count(DISTINCT CASE WHEN 1 - l_discount * 8 >= step - 0.000001 THEN l_partkey END) AS BIGINT) AS cited FROM lineitem CROSS JOIN (SELECT CAST(unnest([1.0, 0.8, 0.6, 0.4, 0.2]) AS DOUBLE) AS step) GROUP BY step")
def _(t):
    rows = t("lineitem").select("l_partkey", (1 - F.col("l_discount") * 8).alias("score"), F.explode(F.array(*map(F.lit, (1.0, 0.8, 0.6, 0.4, 0.2)))).alias("step"))
    hit = F.col("score") >= F.col("step") - 0.000001
    return rows.groupBy("step").agg(F.count_if(hit).alias("n"), F.count_distinct(F.when(hit, F.col("l_partkey"))).alias("cited"))


@query("A26_labels_per_context", "SELECT CAST(least(n, 5) AS BIGINT) AS labels, CAST(count(*) AS BIGINT) AS contexts FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1")
def _(t):
    n = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return n.groupBy(F.least(F.col("n"), F.lit(5)).cast("long").alias("labels")).agg(F.count("*").alias("contexts"))


@query("A27_filtered_distinct", "SELECT CAST(count(DISTINCT l_partkey) AS BIGINT) AS n FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def _(t):
    rich = t("supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    return t("lineitem").join(rich, "l_suppkey", "left_semi").agg(F.count_distinct("l_partkey").alias("n"))


@query("A28_spread", "SELECT l_orderkey, max(l_quantity) - min(l_quantity) AS spread FROM lineitem GROUP BY 1")
def _(t):
    return t("lineitem").groupBy("l_orderkey").agg((F.max("l_quantity") - F.min("l_quantity")).alias("spread"))


@query("A29_agreement", "WITH c AS (SELECT quality AS x, toxic AS y, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2), m AS (SELECT c, sum(n) AS m FROM (SELECT x AS c, n FROM c UNION ALL SELECT y, n FROM c) GROUP BY c), s AS (SELECT sum(n) FILTER (WHERE x = y) AS same, sum(n) FILTER (WHERE x <> y) AS different FROM c), e AS (SELECT sum(m) AS total, sum(m * m) AS squares FROM m) SELECT CAST(same AS BIGINT) AS same, CAST(different AS BIGINT) AS different, round(CAST(same * 1.0 / (same + different) AS DOUBLE), 6) AS observed, round(CAST(1 - (total - 1) * (2.0 * different) / (CAST(total AS DOUBLE) * total - squares) AS DOUBLE), 6) AS alpha FROM s, e")
def _(t):
    return A.agreement(t("labels"), "quality", "toxic").select("same", "different", F.round("observed", 6).alias("observed"), F.round("alpha", 6).alias("alpha"))


@query("A30_confusion", "SELECT quality, CAST(count(*) FILTER (WHERE toxic = 0) AS BIGINT) AS clean, CAST(count(*) FILTER (WHERE toxic = 1) AS BIGINT) AS toxic FROM labels GROUP BY quality")
def _(t):
    return t("labels").groupBy("quality").agg(F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("toxic"))


@query("A32_run_counters", "SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE value > 50) AS BIGINT) AS slow, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def _(t):
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("slow"), F.round(F.avg("value"), 6).alias("mean"))


@query("A33_by_category", "SELECT string_split(o_orderpriority, '-')[1] AS category, CAST(count(*) AS BIGINT) AS docs, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS unmatched FROM orders GROUP BY 1")
def _(t):
    return t("orders").groupBy(F.split("o_orderpriority", "-")[0].alias("category")).agg(F.count("*").alias("docs"), F.count_if(F.col("o_orderstatus") == "O").alias("unmatched"))


@query("A34_first_and_last", "SELECT user_id, arg_min(event_type, event_id) AS first, arg_max(event_type, event_id) AS last FROM events GROUP BY 1")
def _(t):
    return t("events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first"), F.max_by("event_type", "event_id").alias("last"))


@query("A35_claim_frequencies", "SELECT l_returnflag AS subject, l_linestatus AS predicate, CAST(l_linenumber AS BIGINT) AS object, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_linenumber), (l_returnflag, l_linestatus, l_linenumber))")
def _(t):
    rows = t("lineitem").select(F.col("l_returnflag").alias("subject"), F.col("l_linestatus").alias("predicate"), F.col("l_linenumber").cast("long").alias("object"))
    s, p, o = F.col("subject"), F.col("predicate"), F.col("object")
    return rows.groupingSets([[s], [p], [o], [s, p, o]], s, p, o).agg(F.count("*").alias("n"))


@query("A36_split_sizes", "WITH c AS (SELECT l_partkey AS cited, l_orderkey AS citing, count(*) AS n FROM lineitem GROUP BY 1, 2), o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY cited ORDER BY n DESC, citing ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY cited) AS total, row_number() OVER (PARTITION BY cited ORDER BY n DESC, citing) AS rn, count(*) OVER (PARTITION BY cited) AS m FROM c) SELECT before > floor(total * 0.8) OR rn = m AS is_test, CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS contexts FROM o WHERE m >= 2 GROUP BY 1")
def _(t):
    return R.greedy_split(cites(t), "cited", "citing").groupBy("is_test").agg(F.count("*").alias("docs"), F.sum("n").alias("contexts"))


@query("A37_good_by_threshold", "SELECT CAST(count(*) FILTER (WHERE l_discount >= 0.07 AND l_quantity > 25) AS BIGINT) AS good_kept, CAST(count(*) FILTER (WHERE l_discount >= 0.07 AND l_quantity <= 25) AS BIGINT) AS good_cut, CAST(count(*) FILTER (WHERE l_discount <= 0.03 AND l_quantity > 25) AS BIGINT) AS bad_kept, CAST(count(*) FILTER (WHERE l_discount <= 0.03 AND l_quantity <= 25) AS BIGINT) AS bad_cut FROM lineitem")
def _(t):
    good, bad, kept = F.col("l_discount") >= 0.07, F.col("l_discount") <= 0.03, F.col("l_quantity") > 25
    return t("lineitem").agg(F.count_if(good & kept).alias("good_kept"), F.count_if(good & ~kept).alias("good_cut"), F.count_if(bad & kept).alias("bad_kept"), F.count_if(bad & ~kept).alias("bad_cut"))


@query("A38_confidence_grid", "SELECT CAST(least(floor((l_quantity - 5) / 0.5), 49) AS INT) AS bx, CAST(least(floor(l_linenumber / 1.0), 10) AS INT) AS by, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_quantity > 5 AND l_quantity <= 30 AND l_linenumber BETWEEN 0 AND 11 GROUP BY 1, 2")
def _(t):
    return A.grid(t("lineitem").where("l_quantity > 5"), F.col("l_quantity"), F.col("l_linenumber"), (5.0, 30.0, 50), (0.0, 11.0, 11))


@query("A39_relative_distance", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber >= 3 THEN (l_linenumber - 3) / 4.0 ELSE (3 - l_linenumber) / 3.0 END, 6) AS distance FROM lineitem")
def _(t):
    at = F.col("l_linenumber")
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(F.when(at >= 3, (at - 3) / 4.0).otherwise((3 - at) / 3.0), 6).alias("distance"))


@query("A41_marker_totals", r"SELECT CAST(sum(len(regexp_extract_all(text, 'tion[ .,]'))) AS BIGINT) AS n FROM documents")
def _(t):
    return t("documents").agg(F.sum(F.regexp_count("text", F.lit(r"tion[ .,]")).cast("long")).alias("n"))


@query("A42_sentence_totals", r"SELECT lang, CAST(sum(len(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1␞', 'g'), '␞'), lambda x: x <> ''))) AS BIGINT) AS n FROM documents GROUP BY lang")
def _(t):
    s = F.size(F.filter(F.split(F.regexp_replace("text", r"([.!?])\s+", "$1␞"), "␞"), lambda x: x != ""))
    return t("documents").groupBy("lang").agg(F.sum(s.cast("long")).alias("n"))


# windows

SPLIT = "(SELECT cited, citing, CAST(n AS BIGINT) AS n, before > floor(total * 0.8) OR rn = m AS is_test FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY cited ORDER BY n DESC, citing ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY cited) AS total, row_number() OVER (PARTITION BY cited ORDER BY n DESC, citing) AS rn, count(*) OVER (PARTITION BY cited) AS m FROM (SELECT l_partkey AS cited, l_orderkey AS citing, count(*) AS n FROM lineitem GROUP BY 1, 2)) WHERE m >= 2)"


@query("W1_greedy_split", f"SELECT * FROM {SPLIT}")
def _(t):
    return R.greedy_split(cites(t), "cited", "citing")


@query("W2_temporal_split", "SELECT l_orderkey, l_linenumber, year(o_orderdate) > 1996 AS is_test FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(t):
    return t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", (F.year("o_orderdate") > 1996).alias("is_test"))


@query("W3_listed_split", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def _(t):
    held = t("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t("lineitem").join(held, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")


@query("W4_stable_rank", "SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey) AS INT) AS rank FROM lineitem")
def _(t):
    return R.ranked(t("lineitem"), "l_orderkey", F.col("l_quantity"), "l_linenumber").select("l_orderkey", "l_linenumber", "rank")


@query("W5_top_k", "SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn <= 5")
def _(t):
    w = Window.partitionBy("l_partkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return t("lineitem").withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("l_partkey", "l_orderkey", "l_linenumber")


@query("W6_first_per_item", "SELECT q, item, CAST(row_number() OVER (PARTITION BY q ORDER BY first) AS INT) AS rank FROM (SELECT q, item, min(rank) AS first FROM (SELECT l_partkey AS q, l_suppkey AS item, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS rank FROM lineitem) GROUP BY 1, 2)")
def _(t):
    at = F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey"))
    return R.reranked_first(t("lineitem").select(F.col("l_partkey").alias("q"), F.col("l_suppkey").alias("item"), at.alias("rank")), "q", "item")


@query("W7_ties_at_top", "SELECT l_orderkey, l_linenumber FROM (SELECT *, rank() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC) AS r FROM lineitem) WHERE r = 1")
def _(t):
    return t("lineitem").withColumn("r", F.rank().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_discount")))).where("r = 1").select("l_orderkey", "l_linenumber")


@query("W8_export_order", "SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem ORDER BY l_partkey, l_orderkey, l_linenumber")
def _(t):
    return t("lineitem").select("l_partkey", "l_orderkey", "l_linenumber").orderBy("l_partkey", "l_orderkey", "l_linenumber")


@query("W9_group_sample", "SELECT l_partkey FROM (SELECT DISTINCT l_partkey FROM lineitem) ORDER BY (l_partkey * 2654435761) % 4294967296, l_partkey LIMIT 100")
def _(t):
    return t("lineitem").select("l_partkey").distinct().orderBy(F.expr("(l_partkey * 2654435761) % 4294967296"), "l_partkey").limit(100)


@query("W10_stratified", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority, year(o_orderdate) ORDER BY (o_orderkey * 2654435761) % 4294967296, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderpriority, year(o_orderdate)) AS n FROM orders) WHERE rn <= round_even(n * 0.1, 0)")
def _(t):
    rows = t("orders").select("o_orderkey", "o_orderpriority", F.year("o_orderdate").alias("y"))
    return R.stratified(rows, ["o_orderpriority", "y"], 0.1, F.struct(F.expr("(o_orderkey * 2654435761) % 4294967296"), "o_orderkey")).select("o_orderkey")


@query("W11_shuffled", "SELECT doc_id FROM documents")
def _(t):
    return t("documents").select("doc_id").orderBy(F.rand(7))


@query("W12_cumulative_share", "WITH m AS (SELECT strftime(o_orderdate, '%y%m') AS month, count(*) AS n FROM orders GROUP BY 1) SELECT month, round(CAST(sum(n) OVER (ORDER BY month) * 1.0 / (SELECT count(*) FROM orders) AS DOUBLE), 6) AS share FROM m")
def _(t):
    m = t("orders").groupBy(F.date_format("o_orderdate", "yyMM").alias("month")).agg(F.count("*").alias("n"))
    return m.select("month", F.round(F.sum("n").over(Window.orderBy("month")) / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


@query("W13_rank_curve", "SELECT CAST(rn AS BIGINT) AS rn, n FROM (SELECT CAST(count(*) AS BIGINT) AS n, row_number() OVER (ORDER BY count(*) DESC, l_partkey) AS rn FROM lineitem GROUP BY l_partkey) WHERE rn > 1")
def _(t):
    found, _ = R.numbered(t("lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")), F.desc("n"), F.asc("l_partkey"), name="i")
    return found.select((F.col("i") + 1).alias("rn"), "n").where("rn > 1")


@query("W14_neighbours", "SELECT l_orderkey, l_linenumber, lag(l_partkey, 3) OVER w AS before, lead(l_partkey, 3) OVER w AS after FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)")
def _(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    return t("lineitem").select("l_orderkey", "l_linenumber", F.lag("l_partkey", 3).over(w).alias("before"), F.lead("l_partkey", 3).over(w).alias("after"))


@query("W15_best_cluster", "SELECT l_orderkey, arg_max(l_suppkey, l_quantity * 1000000 + l_suppkey) AS cluster FROM lineitem GROUP BY 1")
def _(t):
    return t("lineitem").groupBy("l_orderkey").agg(F.max_by("l_suppkey", F.col("l_quantity") * 1000000 + F.col("l_suppkey")).alias("cluster"))


# sets

@query("U1_union_contexts", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def _(t):
    rows = t("lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    return rows.where("l_returnflag = 'A'").unionByName(rows.where("l_returnflag = 'R'")).drop("l_returnflag")


@query("U2_intersect_items", "SELECT event_type, CAST(value / 10 AS INT) AS item FROM events WHERE user_id % 2 = 0 INTERSECT SELECT event_type, CAST(value / 10 AS INT) FROM events WHERE user_id % 2 = 1")
def _(t):
    rows = t("events").select("event_type", F.round(F.col("value") / 10, 0).cast("int").alias("item"), "user_id")
    return rows.where("user_id % 2 = 0").drop("user_id").intersect(rows.where("user_id % 2 = 1").drop("user_id"))


@query("U3_except_done", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 49")
def _(t):
    return t("part").select(F.col("p_partkey").alias("k")).exceptAll(t("lineitem").where("l_quantity > 49").select("l_partkey").distinct())


@query("U4_distinct_terms", f"SELECT DISTINCT term FROM {TOKENS}")
def _(t):
    return tokens(t).select("term").distinct()


@query("U5_dup_rows", "SELECT DISTINCT text, lang FROM documents")
def _(t):
    return t("documents").select("text", "lang").dropDuplicates()
