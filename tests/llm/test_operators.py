"""Each operator against brute force on a small table, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from compare import database, difference
from conftest import DATA
from pyspark.sql import functions as F

from citelens.llm import decontamination, html_extraction, language_id, media, mixing, ngram_join, queries, secrets, shared, substring_dedup, token_counts, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", None) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, white space, a long text, repeated rows, a null id, and columns with the operators' own names."""
    rng = random.Random(3)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(999)) for _ in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, long), (5, "one two three"), (5, "one two three"), (None, "one two three"), (6, "One two three"), (7, "123 456")]
    d = spark.createDataFrame([(i, t, "en", None, 0) for i, t in rows], DOCS)
    for name in ("n_bytes", "n_tokens", "contamination", "language_id", "secrets", "n", "digest", "rank", "size", "text_key", "p", "x"):
        d = d.withColumn(name, F.lit("clash"))
    return d


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# substring dedup -----------------------------------------------------------------------------------------------------

def test_substring_dedup(spark, docs):
    d = docs.toPandas().sort_values("doc_id")
    got = {r.doc_id: r.text for r in substring_dedup.without_repeats(docs).collect()}
    first = {}
    key = lambda p: " ".join(" ".join(p).lower().split())
    for i, t in zip(d.doc_id, d.text):
        p = substring_dedup.sentences(t)
        assert "".join(p) == t
        for a, b in substring_dedup.runs(p):
            first.setdefault(key(p[a:b]), (i, a))
    for i, t in zip(d.doc_id, d.text):
        p = substring_dedup.sentences(t)
        gone = {k for a, b in substring_dedup.runs(p) if first[key(p[a:b])] != (i, a) for k in range(a, b)}
        assert got[i] == "".join(x for k, x in enumerate(p) if k not in gone)


def test_substring_dedup_all_runs(spark):
    """Against every run of two or more sentences, enumerated here, with sentences far below any word floor."""
    rng = random.Random(7)
    pool = ["Go on. ", "Read it all. ", "No. ", "A line\n", "Of a few more words this time. ", "Why? "]
    parts = [[rng.choice(pool) for _ in range(rng.randrange(1, 5))] + [f"Only {i} has this. "] + [rng.choice(pool) for _ in range(rng.randrange(4))] for i in range(25)]
    first, want = {}, []
    for keep in (False, True):
        for i, p in enumerate(parts):
            gone = set()
            for a in range(len(p)):
                for b in range(a + 2, len(p) + 1):
                    if first.setdefault(" ".join("".join(p[a:b]).lower().split()), (i, a)) != (i, a):
                        gone |= set(range(a, b))
            if keep:
                want.append("".join(x for k, x in enumerate(p) if k not in gone))
    got = {r.doc_id: r.text for r in substring_dedup.without_repeats(documents(spark, ["".join(p) for p in parts])).collect()}
    assert [got[i] for i in range(len(parts))] == want and sum(w != "".join(p) for w, p in zip(want, parts)) > 10


def test_substring_dedup_wide_marks(spark):
    assert substring_dedup.sentences("他来了。「好！」我走。 نعم؟ لا۔ x") == ["他来了。", "「好！」", "我走。 ", "نعم؟ ", "لا۔ ", "x"]
    got = {r.doc_id: r.text for r in substring_dedup.without_repeats(documents(spark, ["他来了。我走了。一。", "二。他来了。我走了。"])).collect()}
    assert got == {0: "他来了。我走了。一。", 1: "二。"}


def test_substring_dedup_odd(odd, empty):
    rows = substring_dedup.without_repeats(odd).collect()
    assert len(rows) == 9 and sum(r.text is None for r in rows) == 1
    assert substring_dedup.without_repeats(empty).count() == 0


# secrets -------------------------------------------------------------------------------------------------------------

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(t):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16])


def test_secret_patterns(spark, docs):
    rng = random.Random(5)
    parts = ["token", "Secret", "api_key", "APIKEY", "password", ": ", "=", '"', "'", " ", "abcdef0123456789", "AKIA", "ABCDEFGHIJ12345678", "é😀", "x", "secret=token: abcdefghijklmnop", "0", "-_/+", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(400)] + [r.text for r in docs.collect()]
    got = secrets.scan(documents(spark, texts)).select("doc_id", "text", "secrets.base", "secrets.spans").collect()
    for r in got:
        assert [(s.start, s.kind, s.end) for s in r.base] == base_spans(r.text)
        assert set(map(tuple, r.base)) <= set(map(tuple, r.spans))


def test_window_entropy(spark):
    from math import log2

    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdefgh0123"[: rng.randrange(1, 13)]) for _ in range(rng.randrange(40))) for _ in range(60)]
    df = documents(spark, texts).select("text", secrets.window_entropy(F.col("text"), 12).alias("e"))
    for r in df.collect():
        windows = [r.text[i : i + 12] for i in range(len(r.text) - 11)]
        want = max((-sum(c / 12 * log2(c / 12) for c in Counter(w).values()) for w in windows), default=0.0)
        assert abs(r.e - want) < 1e-9


def test_entropy_spans(spark):
    texts = ["key is aG9x7Kp2Qv8Zt4Lm1Nw6Rb3Yc5 ok", "an ordinarysentencewithoutanydigitsinside", "id 123e4567-e89b-12d3-a456-426614174000", "sample aG9x7Kp2example8Zt4Lm1Nw6Rb3Yc5"]
    spans = [r.spans for r in secrets.scan(documents(spark, texts)).select("doc_id", "secrets.spans").orderBy("doc_id").collect()]
    assert [(s.start, s.end) for s in spans[0]] == [(7, 33)] and spans[1:] == [[], [], []]


def test_long_candidate(spark):
    """A candidate of a million characters, one that is all words and dashes, and a text of many matches take seconds."""
    import time

    rng = random.Random(1)
    texts = ["".join(rng.choice("AaBb01") for _ in range(1_000_000)), "a-" * 300_000 + "1", " ".join(f"{rng.getrandbits(64):016x}" for _ in range(20_000))]
    began = time.time()
    got = secrets.scan(documents(spark, texts)).select("doc_id", "secrets.spans").orderBy("doc_id").collect()
    assert time.time() - began < 100 and [len(r.spans) for r in got][1:] == [0, 20_000]
    assert [(s.start, s.kind, s.end) for s in got[0].spans] == [x for x in base_spans(texts[0])]


def test_entropy_brute(spark):
    """Spans of both classes against plain Python that counts every window anew."""
    from math import log2

    rng = random.Random(8)
    alphabets = ("0123456789ABCDEF", "0123456789abcXYZ+/", "01AB", "abcdefgh", "ABCDEFGHIJKLMNOPqrstuvwxyz0123456789+/=")
    texts = [" ".join("".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(60))) + rng.choice(["", ".", "=", "_x"]) for _ in range(6)) for _ in range(150)]
    own = "0-9A-Za-z+/_=-"
    patterns = ((3, rf"(?<![{own}])[0-9A-F]{{20,}}(?![{own}])", 20, 3.0, "A-F"), (4, rf"(?<![{own}])[{own}]{{24,}}", 24, 3.9, "A-Za-z"))
    allowed = (r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", "example|placeholder|changeme|dummy|sample|redacted", r"0123456789|abcdefghij|(.)\1{7}", "^/?(?:[a-z]+[/_-])+[a-z]*[0-9]{0,4}$")
    entropy = lambda w: -sum(c / len(w) * log2(c / len(w)) for c in Counter(w).values())
    found = 0
    for r in secrets.scan(documents(spark, texts)).select("text", "secrets.base", "secrets.spans").collect():
        base = [(s.start, s.kind, s.end) for s in r.base]
        want = list(base)
        for kind, pattern, n, bits, letters in patterns:
            for m in re.finditer(pattern, r.text):
                x = m[0]
                if not re.search("[0-9]", x) or not re.search(f"[{letters}]", x) or any(re.search(a, x, re.I) for a in allowed):
                    continue
                if max(entropy(x[i : i + n]) for i in range(len(x) - n + 1)) >= bits - 1e-9 and not any(b[0] < m.end() and m.start() < b[2] for b in base):
                    want.append((m.start(), kind, m.end()))
        assert [(s.start, s.kind, s.end) for s in r.spans] == sorted(want)
        found += len(want) - len(base)
    assert found > 30


def test_redaction(spark):
    out = secrets.without_secrets(spark, documents(spark, ["a token=abcdefghijklmnop b", None, "clean"]), DATA).orderBy("doc_id").collect()
    assert [r.text for r in out] == ["a [secret] b", None, "clean"]


def test_secrets_odd(odd, empty):
    assert secrets.scan(odd).count() == 9 and secrets.scan(empty).count() == 0
    assert "Python" not in secrets.scan(odd)._jdf.queryExecution().toString()


# HTML ----------------------------------------------------------------------------------------------------------------

def test_html_template(spark):
    import html

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    for r in html_extraction.extract(pages).collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1].replace("<br>", "\n")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.main_text == "\n".join(x for x in blocks if x)


def test_html_parts():
    page = '<html><body><div class="wrap"><header><a href=/>Site</a></header><ul class="menu"><li>Home<li>About</ul><div class="post-12 content"><h1>T &amp; <b>b</b></h1><p>First text that is long enough to be counted.<p>Second\n x<div class=ad>buy</div><script>var a="<p>no</p>"</script><ul><li>one<li>two</ul><form><p>Mail</p></form><div id="comments"><p>Great</p></div></div></div><footer>f</footer></body></html>'
    assert html_extraction.main_text(page, None) == "T & b\nFirst text that is long enough to be counted.\nSecond x\none\ntwo"
    assert html_extraction.main_text(None, None) == "" and html_extraction.main_text("", "/a") == ""
    assert html_extraction.main_text("<p>cut <b>off</b", None) == "cut off"


def test_html_nested_wrappers(spark):
    """A wrapper with most of an article's text does not leave out the headline and the other blocks."""
    long = "A paragraph of the article with a good many words in it, number {}."
    page = "<html><body><nav>Home</nav>{}<div class='x'><p>Short.</p></div></body></html>"
    inner = "<h1>Title</h1><div class='content'><p>" + long.format(1) + "</p><p>" + long.format(2) + "</p></div><div class='more'><p>" + long.format(3) + "</p></div>"
    want = "\n".join(["Title", *(long.format(k) for k in (1, 2, 3))])
    for wrap in ("<article>{}</article>", "<main><article class='post'>{}</article></main>", "<main><div class='outer'>{}</div></main>"):
        df = spark.createDataFrame([(i, f"https://h.org/{i}", page.format(wrap.format(inner))) for i in range(3)], "page_id long, url string, html string")
        assert {r.main_text for r in html_extraction.extract(df).collect()} == {want}


LONG = "A paragraph of the article with a good many words in it, number {}."


@pytest.mark.parametrize("page", [
    '<div class="content no-sidebar">{}</div>',
    '<div id="main" class="has-header">{}</div>',
    '<form id="aspnetForm"><input name=q><label>Search</label>{}</form>',
    '<div class="page-with-sidebar"><div class="left-nav"><p>Home and some more words of the menu here, long.</p></div>{}</div>',
    '<header class="site-header"><p>The site and its long, long motto for all who come here.</p></header><article><header>{}</header></article>',
    '<div class="sidebar"><div id="page"><h1>T</h1></div>{}</div>',
    '<main>{}<article id="comment-5" class="comment"><p>Great! A comment of a good many words by a reader.</p></article></main>',
    '<div hidden><p>Not to be seen by anyone who reads this page, ever.</p></div><div>{}</div>',
    '<article>{}<div class="cookieNotice"><p>We use cookies, which you may want to know about.</p></div></article>',
])
def test_html_names(page):
    """Names that only tell how a page looks, wrappers with a telling name, and parts of the article with a name of the page's parts."""
    body = "".join(f"<p>{LONG.format(k)}</p>" for k in range(3))
    want = "\n".join([*(["T"] if "<h1>" in page else []), *(LONG.format(k) for k in range(3))])
    assert html_extraction.main_text(f"<html><body>{page.format(body)}<footer>f</footer></body></html>", None) == want


def test_html_inline_parts():
    page = "<body><article><p><span class='share-button'>Share</span> Some text <span class=ad>Buy!</span>goes on here &amp; there.</p></article></body>"
    assert html_extraction.main_text(page, None) == "Some text goes on here & there."


@pytest.mark.parametrize("page", ["<a" * 200_000, "<p>x<span>" * 60_000, "<span>" * 60_000 + "<p>x</p>" * 60_000, "<span>" * 30_000 + "x<hr>" * 30_000, "<div class='a b'>" * 20_000 + "x", "<p a='" * 50_000, "</x>" * 100_000, "<b>" * 50_000 + "<div></b>" * 50_000, "<li><p>" * 50_000, "a < b & c " * 100_000, "<!--" * 100_000, "&amp" * 200_000])
def test_html_long_and_broken(page):
    import time

    began = time.time()
    html_extraction.main_text(page, None)
    assert time.time() - began < 20


def test_html_hosts(spark):
    """Pages without an article element, on some of which other text outweighs the article: the host's path decides. The generator knows the articles."""
    rng = random.Random(11)
    words = lambda n: " ".join(rng.choice(["tree", "house", "river", "stone", "cloud", "road"]) for _ in range(n)).capitalize() + "."
    rows, want = [], {}
    for host, (tag, body, extra) in enumerate((("div", "post body-0", "box"), ("section", "text-column", "more"), ("div", "left", "right"))):
        for i in range(12):
            paragraphs = [words(rng.randrange(8, 30)) for _ in range(rng.randrange(4, 8))]
            other = [words(rng.randrange(60, 90))] * 3 if i % 4 == 0 else [words(12)]
            title = words(5)
            name = body.replace("0", str(rng.randrange(900)))
            article = f"<h1>{title}</h1><div class='first'><p>{paragraphs[0]}</p></div>" + "".join(f"<p>{p}</p>" for p in paragraphs[1:])
            parts = [f"<{tag} class='{name}'>{article}</{tag}>", f"<div class='{extra}'>" + "".join(f"<p>{p}</p>" for p in other) + "</div>"]
            page = f"<html><body><ul class='menu'><li><a href=/>Home</a></ul><div class='wrap'>{''.join(parts)}</div><div id='footer'>c</div></body></html>"
            rows.append((len(rows), f"https://h{host}.org/{i}", page))
            want[len(rows) - 1] = "\n".join([title, *paragraphs])
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.main_text for r in html_extraction.extract(df).collect()}
    assert got == want
    alone = [html_extraction.main_text(h, None) == want[i] for i, _, h in rows]
    assert not all(alone)  # a page by itself would not do


def test_html_plan(spark):
    """No exchange of pages: only votes are shuffled."""
    df = spark.createDataFrame([(1, "http://a/1", "<p>x</p>")], "page_id long, url string, html string")
    assert "Exchange hashpartitioning" not in html_extraction.extract(df)._jdf.queryExecution().executedPlan().toString()


def test_html_odd(spark):
    rows = [(1, "http://a.example/1", None), (2, None, "<p>no host</p>"), (2, None, "<p>no host</p>"), (3, "nonsense", "")]
    pages = spark.createDataFrame([r + ("clash",) * 5 for r in rows], "page_id long, url string, html string, main_text string, host string, path string, at string, __host string")
    assert sorted((r.page_id, r.main_text) for r in html_extraction.extract(pages).collect()) == [(1, ""), (2, "no host"), (2, "no host"), (3, "")]
    assert html_extraction.extract(pages.limit(0)).count() == 0


# decontamination -----------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_sql(spark, key):
    assert difference(queries.QUERIES[key](spark, DATA), database(DATA), queries.ORACLES[key]) == ""


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_sql_on_odd_rows(spark, tmp_path, key):
    """The SQL agrees where rows are null, empty, repeated or tied as well."""
    rng = random.Random(2)
    words = lambda n: " ".join(rng.choice("ab c. d e! f\n g token=abcdefghij1234 deadbeefdeadbeef01 é".split(" ")) for _ in range(n))
    texts = [words(rng.randrange(1, 60)) for _ in range(25)]
    texts += texts[:6] + [None, "", "  \n", "\n\nx. y. z.", "one", "a. b. a. b.", "key aG9x7Kp2Qv8Zt4Lm1Nw6Rb3Yc5 and ABCDEF0123456789ABCDEF01 ok"]
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows + rows[:2], DOCS).coalesce(1).write.parquet(f"{tmp_path}/w/documents")
    spark.createDataFrame([(1, " ".join(texts[0].split()[:12])), (2, None), (3, "one")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/w/benchmark")
    long = "<p>" + "x" * 1000
    spark.createDataFrame([(1, "u", long), (2, None, long), (3, "u", None), (None, "v", long), (4, "u", ""), (4, "u", "")], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/w/pages")
    (tmp_path / "t").mkdir()
    for name in ("documents", "benchmark", "pages"):
        next((tmp_path / "w" / name).glob("*.parquet")).rename(tmp_path / "t" / f"{name}.parquet")
    assert difference(queries.QUERIES[key](spark, str(tmp_path / "t")), database(str(tmp_path / "t")), queries.ORACLES[key]) == ""


def test_decontamination_blocks_agree(spark, docs):
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    a, b = (decontamination.decontaminate(docs, items, most=m).select("doc_id", "contamination.*").orderBy("doc_id").collect() for m in (10**6, 200))
    assert a == b and sum(len(r["items"]) for r in a) > 0


def test_decontamination_odd(spark, odd, empty):
    items = spark.createDataFrame([(1, "Two THREE"), (2, None), (3, " "), (None, "one"), (4, "two three"), (9, "123 456 789")], "item_id long, text string")
    rows = decontamination.decontaminate(odd, items).select("doc_id", "text", "contamination.*").collect()
    for r in rows:
        three = (r.text or "").lower() == "one two three"
        assert r["items"] == (["1", "4"] if three else []) and [tuple(x) for x in r.runs] == ([(1, 3)] if three else [])
    assert decontamination.decontaminate(empty, items).count() == 0
    assert decontamination.decontaminate(odd, items.limit(0)).where("size(contamination.items) > 0").count() == 0


def test_many_blocks(spark, docs):
    """The plan of fifty blocks is that of two: one function; results are those of one block."""
    import time

    items = spark.createDataFrame([(i, f"w{i} " * 10 + "of the same") for i in range(50)] + [(99, "w7 w7 w7 w7 w7 w7 w7 w7 w7 w7")], "item_id long, text string")
    d = documents(spark, ["x " + "w7 " * 12 + "y", "w3 " * 9, None, "w49 " * 10 + "of"])
    began = time.time()
    many = decontamination.decontaminate(d, items, most=13)
    assert time.time() - began < 30
    one = decontamination.decontaminate(d, items)
    rows = [x.select("doc_id", "contamination.*").orderBy("doc_id").collect() for x in (many, one)]
    assert rows[0] == rows[1] and [r["items"] for r in rows[0]] == [["7", "99"], [], [], ["49"]]
    assert many._jdf.queryExecution().toString().count("scanned(") == one._jdf.queryExecution().toString().count("scanned(")


# tokens --------------------------------------------------------------------------------------------------------------

def test_token_counts(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), token_counts.Counter(path)
    rng = random.Random(1)
    alphabet = " \t\n\r\x0b\x1c\x85 　​aAbé1²½'’s日本😀_!?.…́"
    texts = [r.text for r in docs.collect()] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) + rng.choice(["", "<|endoftext|>", " <|endoftext|>x", "we'll"]) for _ in range(800)]
    texts += ["", "a" * 5000, "aaab" * 700, "ß" * 900]
    for t in texts:
        assert own.count(t) == len(library.encode(t, add_special_tokens=False).ids), t


def test_token_counts_odd(odd, empty):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = token_counts.count_tokens(odd, path).select("doc_id", "text", "n_bytes", "n_tokens", "over_limit").collect()
    assert all(r.n_bytes == len((r.text or "").encode()) and r.over_limit == (r.n_tokens > 1024) for r in rows) and len(rows) == 9
    assert token_counts.count_tokens(empty, path).count() == 0


# WARC ----------------------------------------------------------------------------------------------------------------

def test_warc_round_trip(spark):
    big, small = "é" * 600, "x" * 999
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, small), (4, "http://a/4", small), (5, "u", None), (None, "n", big), (6, "u", ""), (6, "u", ""), (7, "v", "<p>\r\n\r\n</p>")]
    pages = spark.createDataFrame([r + ("clash",) for r in rows], "page_id long, url string, html string, digest string")
    folder = shared.new_folder(spark, "warc-test")
    index = warc.write_archives(pages, folder)
    assert index.count() == len(rows)
    back = Counter((r.id, r.url, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to, bytes(r.payload) if r.payload is not None else None) for r in warc.read_records(index, folder).collect())
    want = Counter()
    for i, u, h in rows:
        p = (h or "").encode()
        full = h != big or i == 2
        want[(None if i is None else str(i), u, "response" if full else "revisit", len(p), hashlib.sha1(p).hexdigest(), None if full else "2", p if full else None)] += 1
    assert back == want
    some = warc.read_records(index.where("id = '7'"), folder).collect()
    assert [bytes(r.payload) for r in some] == [b"<p>\r\n\r\n</p>"]
    assert warc.write_archives(pages.limit(0), shared.new_folder(spark, "warc-none")).count() == 0


def test_warc_parts(spark, monkeypatch):
    """Archives are read by as many tasks as their bytes need, however small their index is; a payload of five million bytes is whole."""
    rng = random.Random(6)
    pages = spark.createDataFrame([(i, f"http://h/{i}", rng.randbytes(2000).hex()) for i in range(60)] + [(60, "http://h/long", "é" * 2_500_000)], "page_id long, url string, html string").coalesce(1)
    folder = shared.new_folder(spark, "warc-parts")
    index = warc.write_archives(pages, folder)
    monkeypatch.setattr(warc, "READ", 10_000)
    monkeypatch.setattr(warc, "TASK_BYTES", 10_000)
    back = warc.read_records(index, folder)
    assert back.rdd.getNumPartitions() > 4
    got = {r.id: r.payload_bytes for r in back.collect()}
    assert got == {str(i): 4000 for i in range(60)} | {"60": 5_000_000}


# mixing --------------------------------------------------------------------------------------------------------------

def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * unit > 2 * sizes[s] + 1e-9}
        if not full:
            return out | {s: weight[s] * unit for s in free}
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        free -= full
    return out


def test_mixing(spark, docs):
    some = docs.withColumn("source", F.when(F.col("doc_id") % 7 > 0, F.col("source")))
    a, b = (mixing.mix(x).select("doc_id", "source", "size", "source_size", "target", "copies", "taken").collect() for x in (some, some.repartition(5)))
    assert sorted(map(tuple, a), key=str) == sorted(map(tuple, b), key=str)
    sizes, taken, biggest = Counter(), Counter(), Counter()
    for r in a:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        biggest[r.source] = max(biggest[r.source], r.size)
        assert r.taken <= 2 * r.size and r.taken == r.copies * r.size
    want = brute_targets(sizes)
    for r in a:
        assert abs(r.target - want[r.source]) < 1e-3 and r.source_size == sizes[r.source]
        assert abs(taken[r.source] - r.target) <= biggest[r.source] / 2 + 1


def brute_copies(rows, target):
    """Copies of each of a source's (doc_id, draw, size, u): t is found by halving, then the Pareto order is walked through."""
    measure = lambda n: 2.0 ** ((max(n, 1).bit_length() - 1) / 2)
    total = lambda t: sum(n * min(2.0, t * measure(n)) for _, _, n, _ in rows)
    low, high = 0.0, 4.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if total(middle) < target else (low, middle)
    due = [min(2.0, high * measure(n)) if target > 0 else 0.0 for _, _, n, _ in rows]
    certain = [int(x + 1e-9) for x in due]
    rest = target - sum(c * n for c, (_, _, n, _) in zip(certain, rows))
    order = sorted((u / (1 - u) * (1 - (x - c)) / (x - c), n, i, k, at) for at, (x, c, (i, k, n, u)) in enumerate(zip(due, certain, rows)) if x - c > 1e-9)
    taken = 0
    for _, n, _, _, at in order:
        if taken > rest or abs(taken + n - rest) > abs(taken - rest):
            break
        certain[at] += 1
        taken += n
    return certain


def test_mixing_ranks(spark, docs):
    """Odds differ inside a source, and decide together with the uniform numbers; against plain Python."""
    rows = mixing.mix(docs).select("doc_id", "draw", "source", "size", "target", "copies", mixing.uniform().alias("u")).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    swapped = 0
    for own in by.values():
        own.sort(key=lambda r: r.doc_id)
        assert [r.copies for r in own] == brute_copies([(r.doc_id, r.draw, r.size, r.u) for r in own], own[0].target)
        swapped += sum(a.u < b.u and a.copies < b.copies for a in own for b in own)
    assert swapped > 0  # a plain order of the uniform numbers would take others


def test_mixing_clash(spark):
    """Other columns pass, also under the operator's own names; the stage's column copy replaces one of its name."""
    d = documents(spark, ["a b c"] * 3 + [None, "x"]).withColumns({c: F.lit("clash") for c in ("copy", "m_id", "rank", "cell", "p", "size", "extra")})
    out = mixing.mixed_copies(spark, d, DATA)
    assert Counter(out.columns) == Counter(d.columns) and {r.cell for r in out.collect()} <= {"clash"}


def test_mixing_odd(odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 9 and sum(r.size == 0 for r in rows) == 3
    assert mixing.mix(empty).count() == 0


# media ---------------------------------------------------------------------------------------------------------------

def test_media_round_trip():
    rng = random.Random(2)
    for n in (64, 128, 4096, 4160, 64 * 1000):
        payload = rng.randbytes(n)
        data = media.container(payload)
        d = media.described(data)
        assert media.payload_of(data, d) == payload and d["codec"] == "raw " and d["samples"] == n // 64
        assert [data[a:b] for a, b in d["keys"]] == [payload[i : i + 64] for i in range(0, n, 4096)]
    with pytest.raises(ValueError):
        media.container(b"")


def test_media_odd(spark, odd):
    rows = odd.select("text", media.media_of_text(F.col("text")).alias("m")).select("text", media.read_back(F.col("m")).alias("b")).select("text", "b.*").collect()
    for r in rows:
        raw = (r.text or "").encode()
        raw += bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
    broken = spark.createDataFrame([(b"",), (b"\0\0\0\x10ftypisom",), (None,), (b"\0\0\xff\xffmoov",)], "m binary").select(media.media_columns(F.col("m")).alias("c")).collect()
    assert all(r.c.codec is None for r in broken)


# language ------------------------------------------------------------------------------------------------------------

def test_language_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.learn(d)
    rows = language_id.language_of(d, model).where(language_id.held_out(F.col("doc_id"))).select("lang", "language_id.*").collect()
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) == h for i, h in d.select("doc_id", language_id.held_out(F.col("doc_id")).alias("h")).collect())
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert sum(r.rejected for r in rows) <= 0.01 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    far = language_id.language_of(documents(spark, ["Это совсем другой язык и алфавит, которого модель не знает. " * 8]), model).first()
    assert far.language_id.rejected


@pytest.mark.parametrize("out", ["de", "en", "es", "fr"])
def test_language_left_out(spark, out):
    """A Latin-script language that the model has not seen, and random letters, are rejected."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and text is not null").collect()
    model = language_id.fit([r.text for r in rows if r.lang != out], [r.lang for r in rows if r.lang != out])
    foreign = [model.predict(r.text)[2] for r in rows if r.lang == out]
    assert sum(foreign) >= 0.95 * len(foreign)
    rng = random.Random(1)
    for n in (100, 400, 2000):
        assert sum(model.predict("".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(n)))[2] for _ in range(50)) >= 48


def plain_grams(text):
    """Counts of a text's hashed 1- to 3-grams in plain Python."""
    letters = [c.lower() if len(c.lower()) == 1 else c for c in text if True]
    kept, last = [" "], True
    for c in letters:
        if c.isalpha():
            kept.append(c)
            last = False
        elif not last:
            kept.append(" ")
            last = True
    # One space where letters end; the end of the text adds its own.
    kept.append(" ")
    word = lambda x: x & 0xFFFFFFFF
    k = 0x9E3779B1
    one = [word(ord(c) * k) for c in kept]
    two = [word((one[i] ^ word(ord(kept[i + 1]) * 0x85EBCA6B)) * k) for i in range(len(kept) - 1)]
    three = [word((two[i] ^ word(ord(kept[i + 2]) * 0xC2B2AE35)) * k) for i in range(len(kept) - 2)]
    return Counter(h >> 17 for h in one[1:-1] + two + three)


def test_language_brute(docs):
    """TF-IDF, unit vectors and the nearest centroid by cosine, against plain Python over the model's own numbers."""
    from math import log, sqrt

    rows = docs.where("lang is not null").limit(80).collect()
    model = language_id.fit([r.text for r in rows], [r.lang for r in rows], k=2)
    assert model.idf.min() >= 1 and all(abs(sum(x * x for x in c.tolist()) - 1) < 1e-3 for c in model.centroids)
    for r in rows[:12]:
        text = r.text[:400]
        v = {g: log(1 + n) * float(model.idf[g]) for g, n in plain_grams(text).items()}
        length = sqrt(sum(x * x for x in v.values()))
        cosines = [sum(x * float(c[g]) for g, x in v.items()) / length for c in model.centroids]
        best = max(range(len(cosines)), key=lambda i: cosines[i])
        lang, score, _ = model.predict(text)
        assert abs(score - cosines[best]) < 1e-4 and lang == model.languages[model.of[best]]


def test_language_null_ids(spark, docs):
    """Rows without an id do not come to the driver together: three times the sample at most, about."""
    many = docs.where("lang is not null").select(F.lit(None).cast("long").alias("doc_id"), "text", "lang", "source", "n_chars")
    many = many.crossJoin(spark.range(20)).withColumn("text", F.concat("text", F.col("id").cast("string"))).drop("id")
    assert len(language_id.learn(many, per_language=5).languages) >= 3


def test_language_odd(odd, empty):
    model = language_id.fit(["the cat sat", "le chat est là", None, "42"], ["en", "fr", "en", "xx"])
    rows = language_id.language_of(odd, model).select("text", "language_id.*").collect()
    for r in rows:
        assert (r.lang_pred == "und") == (not re.search("[a-zA-Z]", r.text or ""))
    assert language_id.language_of(empty, model).count() == 0
    assert language_id.learn(empty).languages == []


# n-gram join ---------------------------------------------------------------------------------------------------------

def brute_groups(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    owners = defaultdict(list)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j, k in Counter(j for g in s for j in owners[g]).items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                root[find(i)] = find(j)
        for g in s:
            owners[g].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows))


def near_copies(rng):
    """Groups of near copies at many distances, a passage that many share, chains, and short texts."""
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(3000))
    passage = [word() for _ in range(30)]
    texts = []
    for size in (2, 3, 40, 120):
        base = [word() for _ in range(rng.choice((24, 60, 150)))]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(0, 6)):
                own[rng.randrange(len(own))] = word()
            texts.append(own)
    texts += [[word() for _ in range(rng.randrange(5, 60))] + passage + [word() for _ in range(rng.randrange(5, 60))] for _ in range(60)]
    texts += [passage[i : i + 25] for i in range(6)] * 3 + [passage[: rng.randrange(1, 7)] for _ in range(12)]
    rng.shuffle(texts)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join(spark, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_LEAST", 8)
    monkeypatch.setattr(ngram_join, "BLOCK", 4000)
    texts = near_copies(random.Random(seed))
    got = ngram_join.jaccard_groups(documents(spark, texts)).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == brute_groups(list(enumerate(texts)))


@pytest.mark.parametrize("seed, ball", [(3, 0.5), (4, 2.0), (5, 0.5)])
def test_ngram_join_large_regions(spark, seed, ball, monkeypatch):
    """Neighbourhoods of many tasks: cut by pivots in Spark, as balls, and with BALL above 1 by Voronoi regions only."""
    rng = random.Random(seed)
    calls = Counter()
    for name in ("cut_by_pivots", "block_members"):
        own = getattr(ngram_join, name)
        monkeypatch.setattr(ngram_join, name, lambda *a, own=own, name=name: (calls.update([name]), own(*a))[1])
    for name, value in (("HOT_LEAST", 8), ("BLOCK", 1500), ("PIVOTS", 5), ("BALL", ball), ("BROADCAST", 5), ("LEAF", 6)):
        monkeypatch.setattr(ngram_join, name, value)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(900))
    # A chain: each text differs a little from the one before, so that it spans many radii; around it a dense ball.
    at, texts = [word() for _ in range(60)], []
    for _ in range(70):
        at = list(at)
        at[rng.randrange(len(at))] = word()
        texts.append(" ".join(at))
    texts += near_copies(rng)
    got = ngram_join.jaccard_groups(documents(spark, texts)).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == brute_groups(list(enumerate(texts)))
    assert calls["cut_by_pivots"] > 0 and calls["block_members"] > 0


def test_main_component():
    assert ngram_join.main_component([(0b0011, 5), (0b0100, 9), (0b0110, 1), (0b1000, 14), (0, 99)]) == 0b0111
    assert ngram_join.main_component([(0, 3)]) == 0 and ngram_join.main_component([]) == 0


def test_join_region_without_dense_rows():
    """A region whose matrix would be too large is joined by posting lists, with the same result."""
    import numpy as np

    rng = np.random.default_rng(4)
    base = rng.choice(10**6, 300, replace=False)
    sets = [np.unique(np.concatenate((base[: rng.integers(200, 300)], rng.integers(0, 10**6, 20)))) for _ in range(60)]
    label = ngram_join.join_region(sets)
    root = list(range(60))
    for i in range(60):
        for j in range(i):
            k = len(np.intersect1d(sets[i], sets[j]))
            if 5 * k >= 4 * (len(sets[i]) + len(sets[j]) - k):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert label.tolist() == root


def test_join_region_large(monkeypatch):
    """A large region of copies, near ones and ones too far to link: no more than two tests for each pair of sets, and a matrix of bounded size."""
    import numpy as np

    rng = np.random.default_rng(5)
    base, sets = rng.choice(10**9, 150, replace=False), []
    for i in range(1500):
        own, gone = base.copy(), rng.integers(0, 75)
        own[rng.choice(150, gone, replace=False)] = rng.integers(0, 10**9, gone)
        sets.append(np.unique(own if i % 10 else np.concatenate((own, sets[-1][:20] if sets else own))))
    sets += [np.unique(np.concatenate((s[:-6], rng.integers(0, 10**9, 6)))) for s in sets[::5]]
    tests, own_common = [], ngram_join.Region.common

    def common(self, rows, others):
        tests.append(len(rows) * len(others))
        assert self.dense is not None and self.dense.size <= 12 * self.n.sum()
        return own_common(self, rows, others)

    monkeypatch.setattr(ngram_join.Region, "common", common)
    owners, root = defaultdict(list), np.arange(len(sets))
    for i, s in enumerate(sets):
        for j, k in Counter(j for g in s.tolist() for j in owners[g]).items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                root[np.isin(root, (root[i], root[j]))] = min(root[i], root[j])
        for g in s.tolist():
            owners[g].append(i)
    for core in (None, np.isin(root, np.bincount(root).argmax()) & (np.arange(len(sets)) % 2 > 0)):
        tests.clear()
        assert (ngram_join.join_region(sets, core) == root).all()
        assert sum(tests) <= len(sets) ** 2


def test_ngram_join_odd(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = ngram_join.jaccard_groups(odd).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == brute_groups(rows)
    assert ngram_join.jaccard_groups(empty).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (None, 3)]
    got = {r.node: r.root for r in shared.components(spark.createDataFrame(chain, "a int, b int")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_filter(spark):
    """No key is missed, few others pass."""
    keys = spark.range(0, 30_000, 3).select(F.xxhash64("id").alias("h"))
    rows = spark.range(30_000).withColumn("in", shared.filter_of(keys)(F.xxhash64("id"))).collect()
    assert all(r["in"] for r in rows if r.id % 3 == 0) and sum(r["in"] for r in rows if r.id % 3) < 1000
    none = spark.range(50).where(shared.filter_of(keys.limit(0))(F.xxhash64("id")))
    assert none.count() == 0


def test_one_of_each_group_odd(spark, odd, empty):
    """Repeated rows stay once, texts without words each time; a null id gives way to the others of its group; other columns stay."""
    d = odd.withColumns({c: F.lit("clash") for c in ("gone", "maybe", "own_key", "gone_id")})
    out = ngram_join.one_of_each_group(spark, d, DATA)
    assert out.columns == d.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter([1, 2, 3, 4, 5, 7])
    assert ngram_join.one_of_each_group(spark, empty, DATA).count() == 0


def test_settings_stay(spark):
    """An operator's own actions use small batches; the session's setting is as before, also after an error."""
    before = spark.conf.get(shared.BATCH_SETTING)
    assert shared.written(spark.range(3), "settings").count() == 3 and spark.conf.get(shared.BATCH_SETTING) == before
    with pytest.raises(ValueError), shared.small_batches(spark):
        assert int(spark.conf.get(shared.BATCH_SETTING).rstrip("b")) == shared.BATCH
        raise ValueError
    assert spark.conf.get(shared.BATCH_SETTING) == before
