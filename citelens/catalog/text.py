"""Text functions over documents, pages, and short texts that the tables give rise to."""

from __future__ import annotations

from pyspark.sql import functions as F

from citelens.catalog.registry import SQL, query
from citelens.functions import spans as S
from citelens.functions import text as X
from citelens.storage import written

W = r"[^\p{L}\p{M}\p{N}_]"
ACC, PLAIN = X.ACCENTED, X.PLAIN
STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
# A reference string for each line item, as both engines make it.
REFERENCE = "concat('A. ', s_name, ', ', p_name, '. Phys. Rev. B ', l_linenumber, ', ', l_partkey, ' (', 1990 + l_linenumber, ') arXiv:', 1000 + l_linenumber, '.', 10000 + l_partkey)"
REFERENCES = f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {REFERENCE} AS ref FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"


def references(t):
    joined = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.expr(REFERENCE).alias("ref"))


def short(t, expr, *more):
    """Line items with one made-up text s."""
    return t("lineitem").select("l_orderkey", "l_linenumber", F.expr(expr).alias("s"), *more)


def short_sql(expr):
    return f"(SELECT l_orderkey, l_linenumber, {expr} AS s FROM lineitem)"


@query("P1_clean", rf"SELECT doc_id, lower(trim(regexp_replace(regexp_replace(text, '[^\p{{L}}\p{{M}}\p{{N}}_\s]+', '', 'g'), '\s+', ' ', 'g'))) AS out FROM documents")
def _(t):
    return t("documents").select("doc_id", X.clean(F.col("text")).alias("out"))


@query("P2_title_key", rf"SELECT doc_id, lower(trim(replace(translate(regexp_replace(regexp_replace(text, '{W}', ' ', 'g'), '\s+', ' ', 'g'), '{ACC}', '{PLAIN}'), 'ß', 'ss'))) AS out FROM documents")
def _(t):
    return t("documents").select("doc_id", X.title_key(F.col("text")).alias("out"))


@query("P3_normalized", rf"SELECT doc_id, lower(trim(regexp_replace(regexp_replace(text, '{W}', ' ', 'g'), '\s+', ' ', 'g'))) AS out FROM documents")
def _(t):
    return t("documents").select("doc_id", X.normalized(F.col("text")).alias("out"))


ENDS = "'t', 'p', 'alt', 'alp', 'author', 'year', 'yearpar', ''"
STAR, OPTIONS, BIB = "CASE WHEN l_linenumber % 2 = 0 THEN '*' ELSE '' END", "repeat('[p. 3]', CAST(l_suppkey % 3 AS INT))", "CASE WHEN l_linenumber % 3 = 0 THEN ' [o]' ELSE '' END"


@query("P4_plain_cites", rf"SELECT l_orderkey, l_linenumber, concat('see \cite', CASE WHEN l_partkey % 8 = 7 THEN concat({STAR}, ' ', {OPTIONS}) ELSE '' END, '{{k', l_partkey, ',x}} then \bibitem{{b', l_suppkey, '}}') AS out FROM lineitem")
def _(t):
    """All cite commands, with and without star and options; the plain one keeps both."""
    tex = rf"concat('see \\cite', element_at(array({ENDS}), CAST(l_partkey % 8 + 1 AS INT)), {STAR}, ' ', {OPTIONS}, '{{k', l_partkey, ',x}} then \\bibitem', {BIB}, '{{b', l_suppkey, '}}')"
    return short(t, tex).select("l_orderkey", "l_linenumber", X.plain_cites(F.col("s")).alias("out"))


@query("P5_without_math", "SELECT l_orderkey, l_linenumber, concat(' a', l_linenumber, '  b  c', l_suppkey) AS out FROM lineitem")
def _(t):
    """Every environment, with and without star, over lines, and every short form."""
    env = f"element_at(array({', '.join(repr(e) for e in X.MATH_ENVIRONMENTS)}), CAST(l_partkey % 9 + 1 AS INT))"
    sign = lambda a, b, c, d: rf"element_at(array('{a}', '{b}', '{c}', '{d}'), l_linenumber % 4 + 1)"
    tex = rf"concat('\\title{{$x$}} \\begin{{document}} a', l_linenumber, ' \\begin{{', {env}, {STAR}, '}}y\n=', l_partkey, '\\end{{', {env}, '}} b ', {sign('$$', '$', r'\\(', r'\\[')}, 'z', {sign('$$', '$', r'\\)', r'\\]')}, ' c', l_suppkey)"
    return short(t, tex).select("l_orderkey", "l_linenumber", X.without_math(X.document_body(F.col("s"))).alias("out"))


@query("P6_markup_stripped", r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS out FROM pages")
def _(t):
    return t("pages").select("page_id", X.stripped_markup(F.col("html")).alias("out"))


ELEMENT = "element_at(array('formula', 'figure', 'table'), l_linenumber % 3 + 1)"


@query("P6b_element_tokens", "SELECT l_orderkey, l_linenumber, concat('see ', ['FORMULA', 'FIGURE', 'TABLE'][l_linenumber % 3 + 1], ' and w end', l_partkey) AS out FROM lineitem")
def _(t):
    """Each element, with children and attributes, and other tags at any depth."""
    bold = lambda tag: f"repeat('{tag}', CAST(l_suppkey % 3 AS INT))"
    xml = f"concat('<p>see <', {ELEMENT}, ' id=\"', l_partkey, '\"><m>x</m>\n<r/></', {ELEMENT}, '> and ', {bold('<b>')}, 'w', {bold('</b>')}, ' end', l_partkey, '</p>')"
    return short(t, xml).select("l_orderkey", "l_linenumber", X.tokens_for_elements(F.col("s")).alias("out"))


UUID_OF = "concat(lpad(hex({0}), 8, '0'), '-0000-4000-8000-000000000000')"


@query("P7_markers_by_key", "SELECT l_orderkey, string_agg(concat(' w', l_linenumber, CASE WHEN p_partkey IS NULL THEN '' ELSE concat('{{cite:', lpad(hex(l_partkey), 8, '0'), '-0000-4000-8000-000000000000}}') END), '' ORDER BY l_linenumber, l_partkey) || '.' AS text, CAST(count(*) AS BIGINT) AS citations, CAST(count(*) - count(p_partkey) AS BIGINT) AS dropped FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size <= 40 GROUP BY l_orderkey")
def _(t):
    """An order is a text that cites its parts by local keys; those of small parts are in its bibliography."""
    from citelens.operators.contexts import placed_markers

    cites = t("lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", F.expr("concat(' w', l_linenumber, '<cit><ref target=\"bid', l_partkey, '\"/></cit>')").alias("s")).alias("c"))
    texts = cites.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("c")).alias("c")).select("l_orderkey", F.concat(F.array_join("c.s", ""), F.lit(".")).alias("text"))
    small = t("part").where("p_size <= 40").select(F.col("p_partkey").alias("l_partkey"))
    keys = t("lineitem").join(small, "l_partkey", "left_semi").select("l_orderkey", F.expr("concat('bid', l_partkey)").alias("key"), F.expr(UUID_OF.format("l_partkey")).alias("uuid")).distinct()
    return placed_markers(texts, keys, "l_orderkey", "text")


CITES = "concat('as ', repeat('CIT , ', l_linenumber % 3), CASE WHEN l_linenumber % 4 = 3 THEN 'CIT' ELSE 'MAINCIT' END, repeat(' , CIT', CAST(l_suppkey % 3 AS INT)), ' say ', l_partkey, ' but CIT', repeat(' , CIT', CAST(l_partkey % 4 AS INT)), ', CIT end')"


@query("P8_merged_cites", "SELECT l_orderkey, l_linenumber, concat('as ', CASE WHEN l_linenumber % 4 = 3 THEN 'CIT' ELSE 'MAINCIT' END, ' say ', l_partkey, ' but CIT, CIT end') AS out FROM lineitem")
def _(t):
    """Runs of one to five tokens, with and without the main one in any place; what stands closer is no run."""
    return short(t, CITES).select("l_orderkey", "l_linenumber", X.merged_cites(F.col("s")).alias("out"))


@query("P9_without_quotes", "SELECT l_orderkey, l_linenumber, concat('so', l_partkey, ' it''s') AS out FROM lineitem")
def _(t):
    """Every quotation mark before and after a word; an apostrophe stays."""
    mark = lambda by: F.substring(F.lit(X.QUOTES), (F.col(by) % len(X.QUOTES) + 1).cast("int"), F.lit(1))
    s = F.concat(mark("l_linenumber"), F.lit("so"), "l_partkey", mark("l_suppkey"), F.lit(" it's"))
    return t("lineitem").select("l_orderkey", "l_linenumber", X.without_quotes(s).alias("out"))


@query("P10_placed_tokens", "SELECT l_orderkey, l_linenumber, concat('a ', repeat('MAINCIT ', CAST(l_linenumber % 3 + 1 AS BIGINT)), 'b', CASE WHEN l_suppkey % 3 > 0 THEN ' ' ELSE '' END, repeat('CIT ', l_suppkey % 3), 'c', l_linenumber) AS out FROM lineitem")
def _(t):
    """One to three markers of the context's own, up to two of others, with and without white space."""
    own = F.expr(UUID_OF.format("l_partkey")).alias("uid")
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", own)
    text = F.expr("concat('a', repeat(concat('{{cite:', uid, '}}\n'), l_linenumber % 3 + 1), 'b', repeat(concat('{{cite:ffffffff-', lpad(hex(l_suppkey), 4, '0'), '-4000-9000-000000000000}}'), CAST(l_suppkey % 3 AS INT)), 'c', l_linenumber)")
    return rows.withColumn("s", text).select("l_orderkey", "l_linenumber", X.placed_tokens(F.col("s"), "uid").alias("out"))


@query("P11_bag_of_words", rf"SELECT doc_id, array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(text, '[!-/:-@\[-`{{-~]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN ({STOP})), ' ') AS out FROM documents")
def _(t):
    return t("documents").select("doc_id", F.array_join(X.bag_of_words(F.col("text")), " ").alias("out"))


@query("P12_words_only", r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[!-/:-@\[-`{-~]', ' ', 'g'), '\s+', ' ', 'g')) AS out FROM documents")
def _(t):
    return t("documents").select("doc_id", X.words_only(F.col("text")).alias("out"))


@query("P13_letter_tokens", r"SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-z]+')) AS BIGINT) AS n FROM documents")
def _(t):
    return t("documents").select("doc_id", F.size(X.letter_words(F.col("text"))).cast("long").alias("n"))


#: Sentences with mentions, and what is left of them.
MENTIONS = (
    ("as shown by Smith and Jones et al. (2004) we go", "as shown by we go"),
    ("in Müller, K. & Weiß 1999a it holds", "in it holds"),
    ("see [12, 15-17] and [Abc99] too", "see and too"),
    ("an interval [a, b] stays, also [12, x]", "an interval [a, b] stays, also [12, x]"),
    ("no Year after Any Name here", "no Year after Any Name here"),
    ("by Ortiz [2011]: so", "by : so"),
    ("from A. B. Ortiz, 2011, on", "from A. B. , on"),
)


@query("P14_without_mentions", f"SELECT l_orderkey, l_linenumber, concat([{', '.join(repr(b) for _, b in MENTIONS)}][l_partkey % {len(MENTIONS)} + 1], ' ', l_linenumber, 'x') AS out FROM lineitem")
def _(t):
    s = f"concat(element_at(array({', '.join(repr(a) for a, _ in MENTIONS)}), CAST(l_partkey % {len(MENTIONS)} + 1 AS INT)), ' ', l_linenumber, 'x')"
    return short(t, s).select("l_orderkey", "l_linenumber", X.squeeze(X.without_mentions(F.col("s"))).alias("out"))


@query("P15_identifiers", f"SELECT l_orderkey, l_linenumber, regexp_extract(ref, '(?i)arXiv:(([a-z0-9-]{{1,15}}/)?[\\d.]{{4,9}}\\d)', 1) AS arxiv, concat('10.1000/x.', l_partkey) AS doi FROM ({REFERENCES})")
def _(t):
    refs = references(t)
    doi = X.found(F.concat("ref", F.lit(" doi 10.1000/x."), "l_partkey"), X.DOI)
    return refs.select("l_orderkey", "l_linenumber", X.paper_id(F.col("ref")).alias("arxiv"), doi.alias("doi"))


@query("P16_repaired_ids", "SELECT l_orderkey, l_linenumber, CASE l_partkey % 3 WHEN 0 THEN concat('quant-ph/', l_partkey, ',', l_partkey) WHEN 1 THEN concat(1000000 + l_partkey, ',', 1000000 + l_partkey, ',', substr(CAST(1000000 + l_partkey AS VARCHAR), 1, 4), '.', substr(CAST(1000000 + l_partkey AS VARCHAR), 5)) ELSE concat('x/abs/1402.', l_partkey, ',1402.', l_partkey) END AS out FROM lineitem")
def _(t):
    s = "CASE l_partkey % 3 WHEN 0 THEN concat('quant-ph/', l_partkey) WHEN 1 THEN CAST(1000000 + l_partkey AS STRING) ELSE concat('x/abs/1402.', l_partkey) END"
    return short(t, s).select("l_orderkey", "l_linenumber", F.array_join(X.repaired_ids(F.col("s")), ",").alias("out"))


@query("P17_with_slash", "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN concat('hep-th/', l_partkey) WHEN 1 THEN concat('1712.', l_partkey) WHEN 2 THEN concat('cs/', l_partkey, 'x9') ELSE concat('math/', l_partkey) END AS out FROM lineitem")
def _(t):
    """Without a slash, without letters, with a second place where one could go, and with a slash already."""
    s = "CASE l_linenumber % 4 WHEN 0 THEN concat('hep-th', l_partkey) WHEN 1 THEN concat('1712.', l_partkey) WHEN 2 THEN concat('cs', l_partkey, 'x9') ELSE concat('math/', l_partkey) END"
    return short(t, s).select("l_orderkey", "l_linenumber", X.with_slash(F.col("s")).alias("out"))


@query("P18_journal_doi", "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN concat('10.1103/physrevb.', l_suppkey, '.', l_partkey) WHEN 1 THEN concat('10.1103/physrevlett.', l_suppkey, '.', l_partkey) WHEN 2 THEN concat('10.1103/revmodphysb.', l_suppkey, '.', l_partkey) END AS out FROM lineitem")
def _(t):
    """Three journals, with and without a year; another journal, and one without a page, have none."""
    forms = "'A. B, Phys. Rev. B {0}, {1}', 'Phys. Rev. Lett. {0} (1994) {1}', 'in Rev. Mod. Phys. B {0}, {1}', 'Nature {0}, {1}', 'Phys. Rev. D {0}'"
    s = f"replace(replace(element_at(array({forms}), l_linenumber % 5 + 1), '{{0}}', CAST(l_suppkey AS STRING)), '{{1}}', CAST(l_partkey AS STRING))"
    return short(t, s).select("l_orderkey", "l_linenumber", X.journal_doi(F.col("s")).alias("out"))


#: References with @ for the title, and the title that is guessed.
GUESSES = (
    ("S, @. Proceedings of X, pages 1-2", "S, @"),
    ("S; @; Journal of Y; Volume 3", " @"),
    ("S. @. 2001", "@"),
    ("A, @, pages 10-12", ""),
    ("A. in @ here. B", "A"),
    ("A, B, @, in the Proceedings of Z", " @"),
    ("S. @ and more. X Transactions on Y. 12", " @ and more"),
    ("S. @ of an old time in Proceedings of Q", "@ of an old time in "),
)


@query("P19_title_guess", f"SELECT l_orderkey, l_linenumber, replace([{', '.join(repr(b) for _, b in GUESSES)}][l_partkey % {len(GUESSES)} + 1], '@', p_name) AS title FROM lineitem JOIN part ON l_partkey = p_partkey")
def _(t):
    """By the delimiter before volume or venue, the part before a venue, else the longest."""
    form = F.expr(f"element_at(array({', '.join(repr(a) for a, _ in GUESSES)}), CAST(l_partkey % {len(GUESSES)} + 1 AS INT))")
    refs = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return refs.select("l_orderkey", "l_linenumber", X.title_guess(F.replace(form, F.lit("@"), F.col("p_name"))).alias("title"))


@query("P20_keyword_query", rf"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(text, '[^\p{{L}}\p{{M}}\p{{N}}_\s]+', ' ', 'g'), '[0-9]+', '', 'g'), '\s+'), lambda w: length(w) > 2 AND w NOT IN ({STOP})), '%2B') AS out FROM documents")
def _(t):
    return t("documents").select("doc_id", X.keyword_query(F.col("text")).alias("out"))


@query("P21_shifted_titles", "WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part), g AS (SELECT p_partkey, a, b, array_to_string(w[a + 1:len(w) - b], ' ') AS title FROM w, range(0, 3) x(a), range(0, 3) y(b) WHERE len(w) > a + b) SELECT DISTINCT p_partkey, title FROM g")
def _(t):
    return t("part").select("p_partkey", F.explode(X.shifted_titles(F.col("p_name"))).alias("g")).select("p_partkey", "g.title").distinct()


@query("P22_word_windows", r"SELECT doc_id, array_to_string(regexp_extract_all(text, '[^\s!-/:-@\[-`{-~]+')[1:50], ' ') AS first50, array_to_string(regexp_extract_all(text, '[^\s!-/:-@\[-`{-~]+')[greatest(1, len(regexp_extract_all(text, '[^\s!-/:-@\[-`{-~]+')) - 49):], ' ') AS last50 FROM documents")
def _(t):
    w = F.regexp_extract_all("text", F.lit(r"([^\s!-/:-@\[-`{-~]+)"), F.lit(1))
    return t("documents").select("doc_id", w.alias("w")).select("doc_id", F.array_join(F.slice("w", 1, 50), " ").alias("first50"), F.array_join(F.slice("w", F.greatest(F.lit(1), F.size("w") - 49), 50), " ").alias("last50"))


GAP = r"[\s!-/:-@\[-`{-~]"
FIFTY = f"^{GAP}*[^{GAP[1:]}+(?:{GAP}+[^{GAP[1:]}+){{49}}"
LAST_FIFTY = f"[^{GAP[1:]}+(?:{GAP}+[^{GAP[1:]}+){{49}}{GAP}*$"


@query("P22b_window_distance", f"SELECT doc_id, CAST(CASE WHEN regexp_matches(text, '{FIFTY}') THEN length(regexp_extract(text, '{FIFTY}')) ELSE length(text) END AS BIGINT) AS forwards, CAST(CASE WHEN regexp_matches(text, '{LAST_FIFTY}') THEN length(regexp_extract(text, '{LAST_FIFTY}')) ELSE length(text) END AS BIGINT) AS backwards FROM documents")
def _(t):
    """Exact characters that a window of 50 words takes, by the scanning function."""
    return t("documents").select("doc_id", S.word_window(F.col("text"), 50, False).alias("forwards"), S.word_window(F.col("text"), 50, True).alias("backwards"))


SENTENCES = r"(SELECT doc_id, unnest(range(1, len(s) + 1)) AS at, unnest(s) AS sentence FROM (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1␞', 'g'), '␞'), lambda x: x <> '') AS s FROM documents))"


def plain_sentences(t):
    s = F.filter(F.split(F.regexp_replace("text", r"([.!?])\s+", "$1␞"), "␞"), lambda x: x != "")
    return t("documents").select("doc_id", F.posexplode(s).alias("p", "sentence")).select("doc_id", (F.col("p") + 1).cast("long").alias("at"), "sentence")


def sentence_windows(t):
    from pyspark.sql import Window

    near = Window.partitionBy("doc_id").orderBy("at").rowsBetween(-1, 1)
    return plain_sentences(t).withColumn("window_text", F.array_join(F.collect_list("sentence").over(near), " ")).drop("sentence")


@query("P23_sentence_windows", f"WITH s AS {SENTENCES} SELECT a.doc_id, a.at, string_agg(b.sentence, ' ' ORDER BY b.at) AS window_text FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.at BETWEEN a.at - 1 AND a.at + 1 GROUP BY a.doc_id, a.at")
def _(t):
    return sentence_windows(t)


@query("P24_sentences", f"WITH s AS {SENTENCES} SELECT doc_id, CAST(count(*) AS BIGINT) AS n, CAST(max(length(sentence)) AS BIGINT) AS longest FROM s GROUP BY doc_id")
def _(t):
    return plain_sentences(t).groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("sentence")).cast("long").alias("longest"))


#: Abbreviations with their full stop: twice, as two may share the space between them. A placeholder of one character keeps the places.
SHORT = "(?i)(^|[\\s(])(" + "|".join(a.replace(".", "\\.") for a in S.ABBREVIATIONS) + ")\\.(\\s|$)"
KEPT = f"regexp_replace(regexp_replace(text, '{SHORT}', '\\1\\2␟\\3', 'g'), '{SHORT}', '\\1\\2␟\\3', 'g')"


@query("P24b_sentence_spans", rf"""WITH p AS (SELECT doc_id, string_split(regexp_replace({KEPT}, '([.!?]+["'')\]]*)(\s|$)', '\1␞\2', 'g'), '␞') AS p FROM documents),
u AS (SELECT doc_id, unnest(p) AS x, unnest(range(1, len(p) + 1)) AS i FROM p), a AS (SELECT doc_id, x, coalesce(sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u)
SELECT doc_id, CAST(before + length(x) - length(regexp_replace(x, '^\s+', '')) AS INT) AS start, CAST(before + length(regexp_replace(x, '\s+$', '')) AS INT) AS end FROM a WHERE regexp_matches(x, '\S')""")
def _(t):
    """Spans with fixed abbreviations that end no sentence."""
    return t("documents").select("doc_id", F.explode(S.sentence_spans(F.col("text"))).alias("s")).select("doc_id", "s.start", "s.end")


MIDDLE = SQL["P24b_sentence_spans"].replace("SELECT doc_id, CAST(before", ", sp AS (SELECT doc_id, CAST(before") + "), nr AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY doc_id) AS n, lag(start) OVER w AS s1, lead(\"end\") OVER w AS e1 FROM sp WINDOW w AS (PARTITION BY doc_id ORDER BY start)) "


@query("P23b_sentence_distance", MIDDLE + "SELECT nr.doc_id, CAST(start + 1 - coalesce(s1, 0) AS BIGINT) AS before, CAST(coalesce(e1, length(text)) - start - 1 AS BIGINT) AS after FROM nr JOIN documents d ON d.doc_id = nr.doc_id WHERE i = (n + 1) // 2 AND \"end\" > start + 1")
def _(t):
    """Three sentences around a place in each text's middle sentence, right behind its first character."""
    return S.middle_distance(t("documents"), 3)


@query("P25_adjacent", "WITH g AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 1500 AND o_orderstatus <> 'P' THEN 0 ELSE 1 END AS cut FROM orders), r AS (SELECT *, sum(cut) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS run FROM g) SELECT a.o_custkey, a.o_orderkey, string_agg(CAST(b.o_orderkey AS VARCHAR), ',' ORDER BY b.o_orderkey) AS adjacent FROM r a JOIN r b ON a.o_custkey = b.o_custkey AND a.run = b.run AND a.o_orderkey <> b.o_orderkey GROUP BY 1, 2")
def _(t):
    from citelens.operators.contexts import adjacent_runs

    rows = t("orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("cited"), (F.col("o_orderstatus") == "P").alias("barrier"))
    return adjacent_runs(rows, "o_custkey", "o_orderkey", "cited", "barrier", gap=1500)


@query("P26_markers", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z]+tion[ .,]')) AS BIGINT) AS n FROM documents")
def _(t):
    return t("documents").select("doc_id", F.regexp_count("text", F.lit(r"[A-Za-z]+tion[ .,]")).cast("long").alias("n"))


@query("P27_spans_in_window", "SELECT a.l_orderkey, a.l_linenumber, CAST(count(*) AS BIGINT) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber <= a.l_linenumber + 2 AND b.l_linenumber + 1 >= a.l_linenumber - 1 AND b.l_quantity > 5.0 GROUP BY 1, 2")
def _(t):
    from citelens.operators.joins import overlap_join

    a = t("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") - 1).alias("lo"), (F.col("l_linenumber") + 2).alias("hi"))
    b = t("lineitem").where("l_quantity > 5.0").select("l_orderkey", F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 1).alias("end"))
    return overlap_join(a, b, ["l_orderkey"], ("lo", "hi"), ("start", "end")).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("P28_preceding_span", "SELECT DISTINCT a.l_orderkey, a.l_linenumber, b.l_suppkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber - b.l_linenumber > 0 AND a.l_linenumber - b.l_linenumber <= 2 WHERE b.l_quantity >= 20")
def _(t):
    from citelens.operators.joins import preceding_join

    a = t("lineitem").select("l_orderkey", "l_linenumber")
    b = t("lineitem").where("l_quantity >= 20").select("l_orderkey", F.col("l_linenumber").alias("at"), "l_suppkey")
    return preceding_join(a, b, ["l_orderkey"], "l_linenumber", "at", 2).select("l_orderkey", "l_linenumber", "l_suppkey").distinct()


def known_phrases(docs, counts):
    """doc_id, chunk: phrases of up to three words that so many documents have (a condition on count), and are in no longer one of their document."""
    from citelens.operators.contexts import grams, maximal_phrases

    g = written(grams(docs, "doc_id", "text", 3), "phrases")
    known = g.groupBy("chunk").count().where(counts).select("chunk")
    return maximal_phrases(g.join(known, "chunk", "left_semi"), "doc_id", "chunk")


@query("P29_phrases")
def _(t):
    """Phrases of four or more documents. It has no SQL: comparing all phrases of a long text with each other takes too long there."""
    return known_phrases(t("documents"), "count >= 4")


@query("P30_phrase_before_marker", r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(regexp_replace(text, '[^a-zA-Z0-9-]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents), g AS (SELECT doc_id, n, array_to_string(w[len(w) - n + 1:], ' ') AS chunk FROM w, range(2, 4) r(n) WHERE len(w) >= n), d AS (SELECT chunk FROM g GROUP BY chunk HAVING count(*) >= 2) SELECT doc_id, max(chunk) FILTER (WHERE n = m) AS chunk FROM (SELECT g.*, max(n) OVER (PARTITION BY doc_id) AS m FROM g JOIN d USING (chunk)) GROUP BY doc_id")
def _(t):
    from citelens.operators.contexts import suffix_grams

    g = suffix_grams(t("documents"), "doc_id", "text", 2, 3)
    known = g.groupBy("chunk").count().where("count >= 2").select("chunk")
    return g.join(known, "chunk").groupBy("doc_id").agg(F.max_by("chunk", "n").alias("chunk"))


TAGS = ("VBD", "NNS", "NNP", "IN", "JJR", "WDT", "RB", "PRP", "DT", "NN", "MD", "VBZ", "CD")
TAG_CLASSES = ("V", "NN", "NNP", "IN", "JJ", "WH", "ADV", "PR", "OTHER", "NN", "OTHER", "V", "OTHER")


@query("P31_pos_classes", f"SELECT conv_id, turn, CASE WHEN [{', '.join(map(repr, TAG_CLASSES))}][conv_id % 13 + 1] = 'OTHER' AND turn % 4 > 0 THEN ['FORMULA', 'FIGURE', 'TABLE'][turn % 4] ELSE [{', '.join(map(repr, TAG_CLASSES))}][conv_id % 13 + 1] END AS class FROM conversations")
def _(t):
    """Tags of every rule, with plain words and with placeholders, which count only where no tag does."""
    tag = F.expr(f"element_at(array({', '.join(map(repr, TAGS))}), CAST(conv_id % 13 + 1 AS INT))")
    word = F.expr("element_at(array('word', 'FORMULA', 'FIGURE', 'TABLE'), CAST(turn % 4 + 1 AS INT))")
    return t("conversations").select("conv_id", "turn", X.pos_class(tag, word).alias("class"))


L = "coalesce(lag(role, {0}) OVER w, '<EOS>')"
R = "coalesce(lead(role, {0}) OVER w, '<EOS>')"


@query("P32_surroundings", f"SELECT conv_id, turn, concat_ws('¦', {L.format(3)}, {L.format(2)}, {L.format(1)}, '[]', {R.format(1)}, {R.format(2)}, {R.format(3)}) AS pattern FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)")
def _(t):
    from citelens.operators.contexts import surroundings

    return surroundings(t("conversations"), ["conv_id"], ["turn", "role", "text"], "role", 3).select("conv_id", "turn", "pattern")


@query("P33_sentence_ends", rf"WITH s AS {SENTENCES}, ww AS (SELECT doc_id, s.at AS place, string_split(trim(regexp_replace(sentence, '\s+', ' ', 'g')), ' ') AS w FROM s) SELECT doc_id, place, array_to_string(w[len(w) - 2:], '¦') AS last3, w[len(w)] = 'the.' AS cit_end FROM ww WHERE len(w) >= 3")
def _(t):
    w = plain_sentences(t).select("doc_id", F.col("at").alias("place"), F.split(X.squeeze(F.col("sentence")), " ").alias("w")).where("size(w) >= 3")
    return w.select("doc_id", "place", F.array_join(F.slice("w", -3, 3), "¦").alias("last3"), (F.element_at("w", -1) == "the.").alias("cit_end"))


@query("P34_positions", "SELECT l_orderkey, l_linenumber, CAST(least(floor(l_linenumber * 1.0 / n * 10), 9) AS INT) AS bucket FROM (SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)")
def _(t):
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy("l_orderkey"))
    return t("lineitem").select("l_orderkey", "l_linenumber", n.alias("n")).select("l_orderkey", "l_linenumber", X.bucket10(F.col("l_linenumber") / F.col("n")).alias("bucket"))


@query("P35_predicates", r"SELECT doc_id, regexp_matches(text, 'tion') AS has, regexp_matches(text, '[.!?]\s*$') AS ends FROM documents")
def _(t):
    return t("documents").select("doc_id", F.col("text").rlike("tion").alias("has"), F.col("text").rlike(r"[.!?]\s*$").alias("ends"))


@query("P36_title_check", rf"WITH d AS (SELECT doc_id, lower(trim(regexp_replace(regexp_replace(text, '[^\p{{L}}\p{{M}}\p{{N}}_\s]+', '', 'g'), '\s+', ' ', 'g'))) AS c FROM documents), b AS (SELECT item_id, lower(trim(regexp_replace(regexp_replace(text, '[^\p{{L}}\p{{M}}\p{{N}}_\s]+', '', 'g'), '\s+', ' ', 'g'))) AS c FROM benchmark) SELECT doc_id, item_id FROM d, b WHERE contains(d.c, b.c)")
def _(t):
    from citelens.operators.joins import contained_titles

    return contained_titles(t("documents").select("doc_id", X.clean(F.col("text")).alias("reference")), t("benchmark").select("item_id", X.clean(F.col("text")).alias("title")), "doc_id", "item_id")


@query("P36b_title_ratio", "SELECT l_orderkey, l_linenumber, [true, true, true, false, false, false][l_linenumber % 6 + 1] AS fits FROM lineitem")
def _(t):
    """A title as it is, in order with other words between, three of four in order, all four in another order, two of four, none."""
    forms = "'x alpha beta gamma delta', 'alpha x beta y gamma z delta', 'x alpha gamma delta', 'delta gamma beta alpha', 'alpha x beta', 'x y'"
    ref = F.concat(F.expr(f"element_at(array({forms}), l_linenumber % 6 + 1)"), F.lit(" "), "l_partkey")
    return t("lineitem").select("l_orderkey", "l_linenumber", X.title_check(F.lit("alpha beta gamma delta"), ref).alias("fits"))


@query("P37_claim_terms", "SELECT p_partkey, concat('show:', lower(trim(regexp_replace(lower(p_name), '[^a-z0-9]', ' ', 'g')))) AS term FROM part")
def _(t):
    return t("part").select("p_partkey", X.claim_term(F.concat(F.lit("SHOW :"), "p_name")).alias("term"))


@query("P38_claim_representation", """WITH w AS (SELECT p_partkey, p_size % 4 AS k, lower(p_brand) AS b, lower(p_type) AS y, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS n, trim(regexp_replace(b, '[^a-z0-9]', ' ', 'g')) AS brand FROM part)
SELECT p_partkey, CAST(1 AS DOUBLE) AS weight, concat('shows:', brand) AS term FROM w WHERE k IN (0, 1) UNION ALL SELECT p_partkey, 1, concat('shows:', a, ' ', y, ' ', n) FROM w WHERE k IN (0, 1)
UNION ALL SELECT p_partkey, 1, concat(n, ':', brand, ' set') FROM w WHERE k = 2 UNION ALL SELECT p_partkey, 0.5, concat('shows:', x) FROM (SELECT p_partkey, unnest([brand, concat(a, ' ', y, ' ', n), concat(brand, ' set')]) AS x FROM w WHERE k = 2)
UNION ALL SELECT p_partkey, 0.25, concat('shows:', x) FROM (SELECT p_partkey, unnest([brand, y, concat(a, ' ', y, ' ', n)]) AS x FROM w WHERE k = 3)""")
def _(t):
    """Parse trees of a verb with subject and object, the object with a compound and an adjective: the marker below the object, below
    the verb, below the object with an apposition of its own and two events, and without a marker."""
    from citelens.functions.parse import claim_terms

    node = lambda i, head, rel, text, tag: F.struct(F.lit(i).alias("idx"), F.lit(head).alias("head") if isinstance(head, int) else head.alias("head"), F.lit(rel).alias("rel"), text.alias("text"), F.lit(tag).alias("tag"))
    k, word = F.col("p_size") % 4, F.split("p_name", " ")
    nodes = [node(1, 2, "nsubj", F.col("p_brand"), "NOUN"), node(2, 0, "root", F.lit("shows"), "VERB"), node(3, 5, "amod", word[0], "ADJ"), node(4, 5, "compound", F.col("p_type"), "NOUN"), node(5, 2, "dobj", word[1], "NOUN")]
    marker = node(6, F.when(k == 1, 2).otherwise(5), "nmod", F.lit("MAINCIT"), "PROPN")
    more = F.when(k < 2, F.array(marker)).when(k == 2, F.array(marker, node(7, 6, "appos", F.lit("set"), "NOUN"), node(8, 7, "compound", F.col("p_brand"), "NOUN")))
    tree = F.concat(F.array(*nodes), F.coalesce(more, F.array().cast("array<struct<idx:int,head:int,rel:string,text:string,tag:string>>")))
    events = F.when(k == 2, F.array(F.lit(2), F.lit(5))).otherwise(F.array(F.lit(2)))
    return t("part").select("p_partkey", F.explode(claim_terms(tree, events)).alias("c")).select("p_partkey", "c.weight", "c.term")


@query("P39_longest_only", "SELECT p_partkey, concat_ws(',', CASE WHEN NOT contains(p_name, p_brand) THEN p_brand END, p_name) AS out FROM part")
def _(t):
    return t("part").select("p_partkey", F.array_join(X.longest_only(F.array(F.col("p_brand"), F.col("p_name"), F.substring("p_name", 2, 3))), ",").alias("out"))


@query("P40_exemplified", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '3 of 1' ELSE '' END AS exemplified FROM part")
def _(t):
    """Trees of "tools such as rings": whole, with another word than "such", with "as" below another node, and with another relation."""
    from citelens.functions.parse import exemplified

    node = lambda i, head, rel, text: F.struct(F.lit(i).alias("idx"), head.alias("head"), rel.alias("rel"), text.alias("text"))
    k = F.col("p_size") % 4
    pick = lambda at, one, other: F.when(k == at, F.lit(one)).otherwise(F.lit(other))
    tree = F.array(node(1, F.lit(0), F.lit("root"), F.lit("tools")), node(2, F.lit(3), F.lit("case"), pick(1, "much", "such")), node(3, F.lit(1), pick(3, "dep", "nmod"), F.split("p_name", " ")[1]), node(4, pick(2, 3, 2), F.lit("mwe"), F.lit("as")))
    pairs = F.transform(exemplified(tree), lambda x: F.concat_ws(" of ", x["example"].cast("string"), x["of"].cast("string")))
    return t("part").select("p_partkey", F.array_join(pairs, ",").alias("exemplified"))


@query("P41_out_degrees", "SELECT n_regionkey, CAST(count(*) AS BIGINT) AS degree FROM nation GROUP BY n_regionkey")
def _(t):
    from citelens.operators.hierarchy import out_degrees

    return out_degrees(t("nation").select(F.col("n_nationkey").alias("child"), F.col("n_regionkey").alias("parent"))).select(F.col("parent").alias("n_regionkey"), "degree")


@query("P42_claim_lines", "SELECT p_partkey, CASE WHEN p_size % 4 < 3 THEN CAST(0.9 AS DOUBLE) END AS confidence, CASE WHEN p_size % 4 < 3 THEN p_brand END AS subject, CASE WHEN p_size % 4 < 3 THEN 'is' END AS predicate, CASE WHEN p_size % 4 < 2 THEN p_type END AS object, CASE WHEN p_size % 4 = 0 THEN concat('T:', p_size) END AS time, CASE WHEN p_size % 4 = 1 THEN 'L:here' END AS place FROM part")
def _(t):
    """With a time, with a place and no context, without an object, and no claim at all."""
    forms = "concat('0.90 Context(x):(', p_brand, '; is; ', p_type, '; T:', p_size, ')'), concat('0.90 (', p_brand, '; is; L:here; ', p_type, ')'), concat('0.90 (', p_brand, '; is)'), concat('(', p_brand, '; is; ', p_type)"
    c = X.claim_line(F.expr(f"element_at(array({forms}), p_size % 4 + 1)"))
    return t("part").select("p_partkey", *[c[n].alias(n) for n in ("confidence", "subject", "predicate", "object", "time", "place")])


INLINE = "concat('see <GC:', l_partkey, '> or <DBLP:', l_suppkey, '>', CASE WHEN l_linenumber % 2 = 0 THEN concat(' and <GC:', l_partkey, '>') ELSE '' END, repeat(' text', CAST(l_linenumber % 3 AS INT)))"


@query("P43_inline_markers", f"SELECT l_orderkey, l_linenumber, m AS cited, regexp_replace(replace({INLINE}, concat('<', m, '>'), 'MAINCIT'), '<(GC|DBLP):[0-9]+>', 'CIT', 'g') AS text FROM (SELECT *, unnest(CASE WHEN l_linenumber % 2 = 0 THEN [concat('GC:', l_partkey), concat('DBLP:', l_suppkey), concat('GC:', l_partkey)] ELSE [concat('GC:', l_partkey), concat('DBLP:', l_suppkey)] END) AS m FROM lineitem)")
def _(t):
    """Two markers, or three of which the first and the last are the same."""
    from citelens.operators.contexts import inline_marker_rows

    return inline_marker_rows(short(t, INLINE), "s").select("l_orderkey", "l_linenumber", "cited", F.col("context").alias("text"))


@query("P44_composite_keys", "SELECT o_orderkey, concat(year(o_orderdate), '_', o_custkey) AS key, '' AS fos FROM orders")
def _(t):
    return t("orders").select("o_orderkey", F.concat_ws("_", F.year("o_orderdate"), "o_custkey").alias("key"), F.lit("").alias("fos"))


@query("P45_inlined", "SELECT p_partkey, concat(substr(p_name, 1, p_size % 3), '[', substr(p_name, p_size % 3 + 1, 2), '](', p_brand, ')', CASE WHEN p_size % 2 = 0 THEN substr(p_name, p_size % 3 + 3) ELSE concat(substr(p_name, p_size % 3 + 3, 1), '[', substr(p_name, p_size % 3 + 4, 3), '](no)', substr(p_name, p_size % 3 + 7)) END) AS out FROM part")
def _(t):
    """A span, and one that meets it, which goes, or one behind it."""
    start = F.col("p_size") % 3
    span = lambda a, b, target: F.struct(a.alias("start"), b.alias("end"), target.alias("target"))
    second = F.when(F.col("p_size") % 2 == 0, span(start + 1, start + 4, F.lit("no"))).otherwise(span(start + 3, start + 6, F.lit("no")))
    return t("part").select("p_partkey", X.inlined(F.col("p_name"), F.array(second, span(start, start + 2, F.col("p_brand")))).alias("out"))


FIELDS = (("cs", "computer science"), ("physics:hep", "physics"), ("q-bio", "other"), ("biology", "biology"), ("math", "mathematics"), ("eess", "other"), ("physics", "physics"), ("econ", "other"), ("stat", "other"))


@query("P46_subject_labels", f"SELECT c_custkey, [{', '.join(repr(b) for _, b in FIELDS)}][c_custkey % {len(FIELDS)} + 1] AS label FROM customer")
def _(t):
    field = F.expr(f"element_at(array({', '.join(repr(a) for a, _ in FIELDS)}), CAST(c_custkey % {len(FIELDS)} + 1 AS INT))")
    return t("customer").select("c_custkey", X.subject_label(field).alias("label"))


CATEGORIES = (("cs.DL", "cs"), ("math-ph astro-ph", "phys"), ("math.CO", "math"), ("econ", None), ("hep-lat", "phys"), ("physics.optics", "phys"), ("math-ph", "math"), ("nlin.CD", "phys"), ("q-bio", None), ("physics.cs", "phys"))


@query("P47_subject_classes", f"SELECT c_custkey, [{', '.join('NULL' if b is None else repr(b) for _, b in CATEGORIES)}][c_custkey % {len(CATEGORIES)} + 1] AS class FROM customer")
def _(t):
    field = F.expr(f"element_at(array({', '.join(repr(a) for a, _ in CATEGORIES)}), CAST(c_custkey % {len(CATEGORIES)} + 1 AS INT))")
    return t("customer").select("c_custkey", X.subject_class(field).alias("class"))


@query("P48_user_ids", """WITH u AS (SELECT event_id, list_transform(regexp_extract_all(hex(encode(concat(user_id, event_type, 'é', props))), '..'), lambda x: CAST(concat('0x', x) AS BIGINT)) AS b FROM events)
SELECT event_id, lower(to_base(CAST((list_sum(list_transform(b, lambda x, i: x * (len(b) - i + 1))) + len(b)) % 65521 * 65536 + (1 + list_sum(b)) % 65521 AS BIGINT), 16)) AS uid FROM u""")
def _(t):
    return t("events").select("event_id", X.adler32(F.concat("user_id", "event_type", F.lit("é"), "props")).alias("uid"))


@query("P49_export_filters", "SELECT doc_id, source FROM documents WHERE lang = 'en' AND text IS NOT NULL AND n_chars > 0")
def _(t):
    return t("documents").where("lang = 'en' AND text IS NOT NULL AND n_chars > 0").select("doc_id", "source")


@query("P50_percentages", "SELECT l_returnflag, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM lineitem) * 100, 2) AS percent FROM lineitem GROUP BY l_returnflag")
def _(t):
    from citelens.operators.aggregates import shares

    return shares(t("lineitem"), ["l_returnflag"]).select("l_returnflag", F.round(F.col("share") * 100, 2).alias("percent"))


@query("P51_tree_lines", "SELECT CAST(s_suppkey AS VARCHAR) AS node, concat(repeat(' ', 4), 's', s_suppkey) AS line FROM supplier")
def _(t):
    """A three-level tree, one line a leaf, indented by its depth."""
    from citelens.operators.hierarchy import ancestors

    s, n, r = "concat('s', s_suppkey)", "concat('n', n_nationkey)", "concat('r', n_regionkey)"
    edges = t("supplier").select(F.expr(s).alias("child"), F.concat(F.lit("n"), "s_nationkey").alias("parent")).unionByName(t("nation").select(F.expr(n).alias("child"), F.expr(r).alias("parent")))
    deep = ancestors(edges).groupBy("node").agg(F.max("depth").alias("depth")).where("node LIKE 's%'")
    return deep.select(F.substring("node", 2, 20).alias("node"), F.concat(F.repeat(F.lit(" "), F.col("depth") * 2), "node").alias("line"))


@query("P52_document_body", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 > 0 THEN concat(' body ', l_partkey, CASE WHEN l_linenumber % 3 = 2 THEN ' \\begin{document} again' ELSE '' END) END AS out FROM lineitem")
def _(t):
    """No begin of a document, one, and two."""
    tex = r"concat('pre', l_suppkey, CASE WHEN l_linenumber % 3 > 0 THEN '\\begin{document} body ' ELSE ' nothing ' END, l_partkey, CASE WHEN l_linenumber % 3 = 2 THEN ' \\begin{document} again' ELSE '' END)"
    return short(t, tex).select("l_orderkey", "l_linenumber", X.document_body(F.col("s")).alias("out"))


@query("P53_multi_keys", "SELECT l_orderkey, l_linenumber, repeat(concat('{{cite:', l_partkey, '}}', '{{cite:x', l_suppkey, '}}'), CAST(l_linenumber % 3 + 1 AS BIGINT)) AS out FROM lineitem")
def _(t):
    """Two, four or six keys, with and without white space."""
    return short(t, "concat(l_partkey, ', x', l_suppkey, repeat(concat(',', l_partkey, ' ,x', l_suppkey), l_linenumber % 3))").select("l_orderkey", "l_linenumber", X.markers_of_keys(F.col("s")).alias("out"))