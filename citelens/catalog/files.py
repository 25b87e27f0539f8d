"""Sources, sinks and streams, each as a round trip through the shared folder."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from citelens.catalog.registry import query
from citelens.sources import contexts as C
from citelens.sources import files as S
from citelens.storage import new_folder, written
from citelens.streaming import online as O


def trip(t, lines, name):
    path = new_folder(t.spark, name)
    lines.write.text(path)
    return t.spark.read.text(path)


#: Submissions of fifty documents at most, members in an order of their own, some of them no TeX files.
MEMBER = "concat(doc_id, CASE WHEN doc_id % 5 = 0 THEN '.txt' ELSE '.tex' END)"
ARCHIVE = "concat(source, '-', {0}, '.tar.gz')"
DUCK_ARCHIVE, PLACE = ARCHIVE.format("doc_id // 50"), "md5(CAST(doc_id AS VARCHAR))"


def archives(t):
    rows = t("documents").select(F.expr(ARCHIVE.format("doc_id div 50")).alias("path"), F.expr(MEMBER).alias("member"), F.md5(F.col("doc_id").cast("string")).alias("place"), F.concat(F.lit("\\begin{document}"), "text").alias("text"))

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"path": [group["path"].iloc[0]], "content": [S.archive_of(group.sort_values("place"))]})

    return rows.groupBy("path").applyInPandas(packed, "path string, content binary")


@query("S1_archives", f"SELECT {DUCK_ARCHIVE} AS path, {MEMBER} AS member, CAST(length(text) + 16 AS BIGINT) AS n FROM documents")
def _(t):
    """Two runs: the second finds the first one's archives in the list of those that are done."""
    done, out = new_folder(t.spark, "archives-done"), new_folder(t.spark, "members")
    every = written(archives(t), "archives")
    S.resumed(every.where(F.crc32("path") % 2 == 0), done, out)
    return S.resumed(every, done, out).select("path", "member", F.length("text").cast("long").alias("n"))


@query("S2_main_source", f"SELECT {DUCK_ARCHIVE} AS path, arg_max({MEMBER}, (doc_id % 5 > 0, {PLACE})) AS member FROM documents GROUP BY 1")
def _(t):
    """The last TeX file in the archive's order; of an archive without any, the last of its files."""
    return S.main_sources(S.archive_members(archives(t)), ["path"]).select("path", "member")


@query("S3_decoded", "SELECT doc_id, CASE WHEN doc_id % 5 = 4 AND length(text) > 0 THEN concat(text, 'é', chr(65533), 'x') ELSE concat('é', text) END AS text FROM documents")
def _(t):
    """UTF-8, UTF-16 with and without a mark, an 8-bit encoding, and bytes that fit none, which are replaced."""
    def stored(x, k):
        s = "é" + x
        eight = k == 3 and not s.encode("cp1252", "ignore").decode("cp1252") != s
        return x.encode() + "é".encode() + b"\x81x" if k == 4 and x else s.encode("utf-16") if k == 1 else s.encode("utf-16-le") if k == 2 and s.isascii() else s.encode("cp1252") if eight else s.encode()

    def read(batch, i):
        doc, text, k = (batch.column(c)[i].as_py() for c in range(3))
        yield doc, S.decoded(stored(text, k))

    docs = t("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % 5).cast("int").alias("k"))
    return S.one_at_a_time(docs, read, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string")


@query("S4_text_files", "SELECT replace(r_name, ' ', '_') AS doc_id, concat('text of ', r_name, chr(10), 'line') AS text FROM region")
def _(t):
    """Files by their names: texts, a log, and a file of another kind, of which only the texts are read."""
    path = new_folder(t.spark, "texts")
    text = F.concat(F.lit("text of "), "r_name", F.lit("\nline"))
    files = t("region").select(F.concat(F.replace("r_name", F.lit(" "), F.lit("_")), F.lit(".txt")).alias("name"), text.alias("text"))
    S.write_named(files.unionByName(t.spark.createDataFrame([("log.txt", "a log"), ("notes.dat", "no text")], "name string, text string")), path)
    return S.read_texts(t.spark, path)


@query("S5_context_lines", "SELECT CAST(l_partkey AS VARCHAR) AS cited_id, CAST(l_orderkey AS VARCHAR) AS citing_id, concat('text ', l_linenumber) AS text, CAST(CASE WHEN l_linenumber % 2 = 0 THEN 2 ELSE 0 END AS BIGINT) AS n_adjacent, l_returnflag AS fos FROM lineitem")
def _(t):
    none = F.array().cast("array<string>")
    adjacent = F.when(F.col("l_linenumber") % 2 == 0, F.array(F.col("l_suppkey").cast("string"), F.lit("x"))).otherwise(none)
    rows = t("lineitem").select(F.col("l_partkey").cast("string").alias("cited_id"), adjacent.alias("adjacent"), F.col("l_orderkey").cast("string").alias("citing_id"), F.concat(F.lit("text "), "l_linenumber").alias("text"), F.array("l_returnflag").alias("fos"))
    back = C.parse_contexts(trip(t, C.context_lines(rows), "contexts"))
    return back.select("cited_id", "citing_id", "text", F.size("adjacent").cast("long").alias("n_adjacent"), F.col("fos")[0].alias("fos"))


@query("S6_comma_lines", "SELECT CAST(p_partkey AS VARCHAR) AS f1, p_brand AS f2, p_name AS f3 FROM part")
def _(t):
    return C.parse_ragged(trip(t, t("part").select(F.concat_ws(",", "p_partkey", "p_brand", "p_name")), "comma"), 3)


@query("S7_ragged_tail", "SELECT CAST(p_partkey AS VARCHAR) AS f1, concat(p_brand, ',', p_type, ',', p_size) AS f2 FROM part")
def _(t):
    return C.parse_ragged(trip(t, t("part").select(F.concat_ws(",", "p_partkey", "p_brand", "p_type", "p_size")), "ragged"), 2)


@query("S8_pair_lines", "SELECT l_orderkey AS a, l_partkey AS b, l_returnflag AS text FROM lineitem WHERE l_linenumber <> 3")
def _(t):
    line = F.when(F.col("l_linenumber") == 3, F.lit("broken line")).otherwise(F.concat("l_orderkey", F.lit(","), "l_partkey", F.lit(',"'), "l_returnflag", F.lit('"')))
    return C.parse_pairs(t("lineitem").select(line.alias("value")))


@query("S9_tab_separated", "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS level FROM nation WHERE n_regionkey < 4")
def _(t):
    level = F.when(F.col("n_regionkey") < 4, F.col("n_regionkey").cast("string")).otherwise("bad")
    back = trip(t, t("nation").select(F.concat_ws("\t", "n_nationkey", "n_name", level)), "tabs")
    f = F.split("value", "\t")
    return back.select(f[0].cast("int").alias("id"), f[1].alias("name"), F.expr("try_cast(split(value, '\t')[2] AS int)").alias("level")).where("level IS NOT NULL")


@query("S10_xml_records", "SELECT n_nationkey AS id, n_name AS title FROM nation")
def _(t):
    """Documents of ten records each."""
    path = new_folder(t.spark, "records")
    record = S.xml_record("record", id=F.col("n_nationkey"), title=F.col("n_name"))
    ten = t("nation").groupBy(F.floor(F.col("n_nationkey") / 10).alias("k")).agg(F.concat(F.lit("<records>"), F.array_join(F.collect_list(record), ""), F.lit("</records>")).alias("value"))
    ten.repartition("k").write.partitionBy("k").text(path)
    return S.read_records(t.spark, path, "record", "id int, title string").select("id", "title")


@query("S11_xpath", "SELECT CAST(count(*) AS BIGINT) AS n FROM nation WHERE n_name LIKE 'A%' OR n_name LIKE 'N%'")
def _(t):
    xml = S.xml_record("record", title=F.col("n_name"))
    title = F.xpath_string(xml, F.lit("record/title"))
    return t("nation").select(title.alias("x")).where("x LIKE 'A%' OR x LIKE 'N%'").agg(F.count("*").alias("n"))


@query("S12_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    return t("events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("S13_table_scan", "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0")
def _(t):
    return t("supplier").where("s_acctbal > 0").select("s_suppkey", "s_name")


@query("S14_judgements", "SELECT CAST(user_id AS VARCHAR) AS uid, CAST(event_id AS INT) AS item, event_type AS mark FROM events")
def _(t):
    line = F.concat_ws(C.ITEM, F.lit("1552000000"), "user_id", "event_id", F.concat(F.lit('{"cit_type":"'), "event_type", F.lit('","bow1":"1"}')))
    return C.parse_judgements(t("events").select(line.alias("value"))).select("uid", "item", F.col("marks")["cit_type"].alias("mark"))


@query("S15_term_lines", "SELECT DISTINCT p_type AS term FROM part")
def _(t):
    return trip(t, t("part").select("p_type").distinct(), "terms").withColumnRenamed("value", "term")


@query("S16_named_numbers", "SELECT p_name AS name, CAST(p_size AS BIGINT) AS number FROM part WHERE p_size % 2 = 0")
def _(t):
    line = F.concat_ws(": ", "p_name", F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("n/a"))
    return C.parse_named_numbers(t("part").select(line.alias("value")))


@query("S17_offline_lookup", "SELECT l_orderkey, l_linenumber, s_name FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal > 0")
def _(t):
    known = t("supplier").where("s_acctbal > 0").select("s_suppkey", "s_name")
    return t("lineitem").join(known, F.col("l_suppkey") == F.col("s_suppkey"), "left").select("l_orderkey", "l_linenumber", "s_name")


@query("S18_sampled_members", f"SELECT {DUCK_ARCHIVE} AS path, CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id % 10 = 0")
def _(t):
    """Only members that a sample lists are taken out of the archives."""
    wanted = t("documents").where("doc_id % 10 = 0").select(F.col("doc_id").cast("string").alias("id"))
    found = S.archive_members(archives(t)).select("path", F.replace(F.regexp_extract("member", r"^(.*)\.[a-z]+$", 1), F.lit("/")).alias("id"))
    return found.join(wanted, "id", "left_semi").select("path", "id")


@query("S19_merged_lists", "SELECT n_regionkey AS id, string_agg(n_name, ' ' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def _(t):
    path = new_folder(t.spark, "lists")
    lines = t("nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), " ").alias("line"))
    lines.select("line", "n_regionkey").write.partitionBy("n_regionkey").text(path)
    return t.spark.read.text(path).select(F.col("n_regionkey").alias("id"), F.col("value").alias("names"))


@query("K1_contexts_by_cited", "SELECT l_partkey % 16 AS part, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def _(t):
    path = new_folder(t.spark, "contexts-by-cited")
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") % 16).alias("part"))
    rows.repartition("part").write.partitionBy("part").parquet(path)
    return t.spark.read.parquet(path).groupBy(F.col("part").cast("long").alias("part")).agg(F.count("*").alias("n"))


@query("K2_appended", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <= 2")
def _(t):
    path = new_folder(t.spark, "appended")
    for i in (1, 2):
        t("lineitem").where(F.col("l_linenumber") == i).select("l_orderkey", "l_linenumber").write.mode("append").parquet(path)
    return t.spark.read.parquet(path)


@query("K3_updated", "SELECT p_partkey, CASE WHEN p_size > 40 THEN 'large' ELSE p_brand END AS p_brand FROM part")
def _(t):
    return S.updated(t("part").select("p_partkey", "p_brand"), t("part").where("p_size > 40").select("p_partkey", F.lit("large").alias("p_brand")), "p_partkey", "p_brand")


@query("K4_json_result", "SELECT l_partkey, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def _(t):
    """In four batches, two of which are there from a run that was stopped."""
    path = new_folder(t.spark, "result")
    counts = written(t("lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")), "counts")
    for i in (0, 2):
        counts.where(F.pmod(F.xxhash64("l_partkey"), F.lit(4)) == i).write.json(f"{path}/batch={i}")
    return S.write_in_batches(counts, F.col("l_partkey"), 4, path).select("l_partkey", "n")


@query("K5_fan_out", "SELECT n_nationkey, n_name FROM nation")
def _(t):
    path = new_folder(t.spark, "single")
    t("nation").select("n_nationkey", S.xml_record("record", name=F.col("n_name"))).write.partitionBy("n_nationkey").text(path)
    return t.spark.read.text(path).select("n_nationkey", F.xpath_string("value", F.lit("record/name")).alias("n_name"))


@query("K6_search_documents", "SELECT n_nationkey, concat('<add><doc><field name=\"id\">', n_nationkey, '</field><field name=\"title\">', n_name, '</field></doc></add>') AS doc FROM nation")
def _(t):
    return t("nation").select("n_nationkey", S.search_document(id=F.col("n_nationkey"), title=F.col("n_name")).alias("doc"))


@query("K7_parted_outputs", "SELECT CASE WHEN regexp_matches(text, 'tion') THEN 'cit' ELSE 'no_cit' END AS place, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1")
def _(t):
    path = new_folder(t.spark, "parted")
    rows = t("documents").select("doc_id", F.when(F.col("text").rlike("tion"), "cit").otherwise("no_cit").alias("place"))
    rows.write.partitionBy("place").parquet(path)
    return t.spark.read.parquet(path).groupBy("place").agg(F.count("*").alias("n"))


@query("K8_batches", "SELECT doc_id, CAST(least(floor(i / floor(n / 7)), 6) AS INT) AS batch FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)")
def _(t):
    return S.numbered_batches(t("documents").select("doc_id"), 7, F.col("doc_id"))


def event_files(t, name, parts=4):
    path = new_folder(t.spark, name)
    t("events").withColumn("ts", F.col("ts").cast("timestamp")).repartitionByRange(parts, "event_id").write.parquet(path)
    return path, t.spark.read.parquet(path).schema


@query("K9_appended_log", "SELECT event_id, user_id FROM events")
def _(t):
    path, schema = event_files(t, "log")
    out = new_folder(t.spark, "log-table")
    O.append_log(t.spark.readStream.schema(schema).parquet(path).select("event_id", "user_id"), out, new_folder(t.spark, "log-state"))
    return t.spark.read.parquet(out)


@query("K10_plot_table", "SELECT lang, CAST(floor(n_chars / 1000) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1, 2")
def _(t):
    return t("documents").groupBy("lang", F.floor(F.col("n_chars") / 1000).cast("long").alias("bin")).agg(F.count("*").alias("n"))


MODEL = "WITH c AS (SELECT lang AS cand, term, CAST(count(*) AS DOUBLE) AS w FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents) GROUP BY 1, 2), cn AS (SELECT cand, term, w / sqrt(sum(w * w) OVER (PARTITION BY cand)) AS w FROM c), q AS (SELECT item_id AS q, term, CAST(count(*) AS DOUBLE) AS w FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM benchmark) GROUP BY 1, 2), qn AS (SELECT q, term, w / sqrt(sum(w * w) OVER (PARTITION BY q)) AS w FROM q), s AS (SELECT q, cand, round(sum(qn.w * cn.w), 9) AS score FROM qn JOIN cn USING (term) GROUP BY 1, 2) SELECT q, cand, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, cand) AS rank FROM s) WHERE rank <= {0} AND score > 0"


def language_model(t):
    from citelens.functions.text import letter_words
    from citelens.plans.vectors import normalized

    words = t("documents").select(F.col("lang").alias("cand"), F.explode(letter_words(F.col("text"))).alias("term"))
    return normalized(words.groupBy("cand", "term").agg(F.count("*").cast("double").alias("w")), "cand")


def scored_stream(t, most):
    path, out = new_folder(t.spark, "requests"), new_folder(t.spark, "answers")
    t("benchmark").select(F.col("item_id").alias("q"), "text").repartition(2).write.parquet(path)
    model = new_folder(t.spark, "model")
    language_model(t).write.parquet(model)
    O.score_contexts(t.spark.readStream.schema("q long, text string").option("maxFilesPerTrigger", 1).parquet(path), t.spark.read.parquet(model), out, new_folder(t.spark, "answers-state"), most)
    return t.spark.read.parquet(out).select("q", "cand", "rank")


@query("T1_online_scores", MODEL.format(5))
def _(t):
    return scored_stream(t, 5)


@query("R17_online_top", MODEL.format(1))
def _(t):
    return scored_stream(t, 1)


@query("T2_folded_log", "SELECT user_id, event_type, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2")
def _(t):
    path, schema = event_files(t, "judgements")
    out = new_folder(t.spark, "folded")
    O.fold_judgements(t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(path), ["user_id", "event_type"], "value", ["event_id"], out, new_folder(t.spark, "folded-state"))
    return t.spark.read.parquet(out)


@query("T3_resumed", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END AS run FROM events")
def _(t):
    path, out, state = (new_folder(t.spark, n) for n in ("arrivals", "arrived", "arrived-state"))
    for run in (1, 2):
        t("events").where(F.col("event_id") % 2 == run - 1).select("event_id").write.mode("append").parquet(path)
        O.append_log(t.spark.readStream.schema("event_id long").parquet(path).withColumn("run", F.lit(run)), out, state)
    return t.spark.read.parquet(out)
