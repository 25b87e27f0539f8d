"""HTML extraction by consensus host paths: containers are scored on each page, Spark votes on paths per host, pages are read again by the winning paths."""

from __future__ import annotations

import hashlib
import html
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citelens.llm.shared import table, unused, written

# Fixed values of HTML: elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: No part of an article, wherever they stand.
DROPPED = frozenset("head script style noscript template nav menu footer aside button select option textarea label legend iframe svg object canvas audio video dialog title".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
#: A p ends where one of these begins.
CLOSES_P = BLOCK - frozenset("dd dt li tbody td tfoot th thead tr optgroup option body html".split())
#: Elements that end an open one of their kind, and those that keep them from it.
KINDS = ("p", "li", "dd", "tr", "td", "option")
KIND_OF = {"p": 0, "li": 1, "dt": 2, "dd": 2, "tr": 3, "td": 4, "th": 4, "option": 5}
BARS = {1: frozenset(("ul", "ol", "menu")), 2: frozenset(("dl",)), 3: frozenset(("table",)), 4: frozenset(("table", "tr")), 5: frozenset(("select",))}
#: Words that mark a class or id, by which an element is no part of the article. One counts as the whole name, or as its first or last part.
NOISE = frozenset("ad ads advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments commentlist respond disqus cookie cookies consent gdpr footer masthead menu nav navbar navigation newsletter notice notices pagination pager paging popup modal overlay promo promos promoted related recommended recommendations share sharing shares sidebar skip social sponsor sponsored sponsors subscribe subscription signup login toolbar widget widgets tags teaser teasers".split())
#: These count as the whole name or its last part, as in site-header, but not in the name of an article's own part.
LATE_NOISE = frozenset("header side foot".split())
ARTICLE_WORDS = frozenset("article post entry story content main body text page section title".split())
#: A name with one of these tells how the rest of the page looks, as in no-sidebar.
STATES = frozenset("no not non without with has have is are hide hidden show off on".split())
GOOD_NAME = re.compile(r"article|content|post|entry|story|body|text|main", re.I)
CONTAINERS = frozenset("article main section div td body form".split())
#: What a container's text counts for, and how much of it counts for the container around.
WORTH = {"article": 1.3, "main": 1.2, "body": 0.85, "form": 0.85, "td": 0.95}
UPWARDS, GOOD_WORTH, TITLE_WORTH = 0.8, 1.1, 1.25
#: Text in these is of the article's kind, however short.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dd dt td th figcaption".split())
HEADINGS = frozenset(("h1", "h2"))
LONG = 40

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>][^\s=/>]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>][^\s>]*+)))?")
_END_OR_QUOTE = re.compile(r">|=\s*+([\"'])")
_TELLING = re.compile(r"class|id|role|hidden|style", re.I)
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*+")
_DIGITS = re.compile(r"\d+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


def noisy(name: str) -> bool:
    """Whether a class or id says that an element is no part of the article."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    if not parts or STATES & set(parts):
        return False
    if parts[0] in NOISE or parts[-1] in NOISE:
        return True
    return parts[-1] in LATE_NOISE and not ARTICLE_WORDS & set(parts)


def step_name(tag: str, names: dict) -> str:
    """An element's step in a generalised path: its tag and its classes, or its id where it has none, numbers put alike."""
    own = sorted(set((names.get("class") or "").split())) or (["#" + names["id"]] if names.get("id") else [])
    return _DIGITS.sub("0", ".".join([tag, *own]))


HARD, SOFT = 2, 1


@lru_cache(maxsize=8192)
def described(tag: str, attributes: str) -> tuple[str, int]:
    """An element's step in a path ("" for inline elements), and whether it is dropped: HARD always, SOFT unless it turns out to hold the page."""
    names = {a.lower(): html.unescape(x or y or z or "") for a, x, y, z in _ATTRIBUTE.findall(attributes)} if attributes else {}
    step = step_name(tag, names) if tag in BLOCK else ""
    if tag in DROPPED or (names.get("role") in DROPPED_ROLES and tag not in ("body", "main", "article")):
        return step, HARD
    marked = [x for c in ("class", "id") for x in (names.get(c) or "").split()]
    style = (names.get("style") or "").replace(" ", "").lower()
    soft = tag == "form" or "hidden" in names or names.get("aria-hidden") == "true" or "display:none" in style
    if tag == "article":
        soft = soft or any(noisy(x) and "comment" in x.lower() for x in marked)
    elif tag not in ("html", "body", "main"):
        soft = soft or any(noisy(x) for x in marked)
    return step, SOFT if soft else 0


@lru_cache(maxsize=65536)
def path_key(above: int, step: str) -> int:
    """A path's key: 63 bits of a hash of the path above and its last step."""
    return int.from_bytes(hashlib.blake2b(f"{above}/{step}".encode("utf-8", "replace"), digest_size=8).digest(), "big") >> 1


class Node:
    __slots__ = ("tag", "key", "depth", "drop", "parent", "home", "inside", "scope", "plain", "good", "tells", "inline", "block", "named", "titled")

    def __init__(self, tag, key, depth, drop, parent):
        self.tag, self.key, self.depth, self.drop, self.parent = tag, key, depth, drop, parent
        # home: the nearest article or main that it is or is in; inside: whether there is one.
        self.home = self if tag in ("article", "main") else parent.home if parent else None
        self.inside = self.home is not None
        self.scope = parent.scope if parent else (-1,) * len(KINDS)
        # Inline elements open in the nearest block, by tag.
        self.inline = {} if tag in BLOCK or not parent else parent.inline
        self.block = tag if tag in BLOCK or not parent else parent.block
        self.plain, self.good, self.tells, self.named, self.titled = 0, 0.0, False, False, tag == "h1"


def events(page: str):
    """("open", node), ("close", node), ("text", string, node), ("void", tag, node) in page order, in time linear in the page.

    Unclosed elements are closed as HTML does, the rest at the end; a tag or quoted value that the page's end cuts off is no text."""
    root = Node("", 0, 0, 0, None)
    stack, counts = [root], {}
    at, size = 0, len(page)

    def shut(down_to):
        while len(stack) > down_to:
            node = stack.pop()
            counts[node.tag] -= 1
            if node.tag not in BLOCK:
                node.inline[node.tag] -= 1
            yield "close", node

    while at < size:
        less = page.find("<", at)
        if less < 0:
            yield "text", page[at:], stack[-1]
            break
        mark = page[less + 1 : less + 2]
        if mark == "!" or mark == "?":
            if less > at:
                yield "text", page[at:less], stack[-1]
            if page.startswith("<!--", less):
                end = page.find("-->", less + 2)
                at = size if end < 0 else end + 3
            else:
                end = page.find(">", less)
                at = size if end < 0 else end + 1
            continue
        close = mark == "/"
        name = _NAME.match(page, less + 1 + close)
        if name is None:
            if close:  # no tag: dropped up to its end
                if less > at:
                    yield "text", page[at:less], stack[-1]
                end = page.find(">", less)
                at = size if end < 0 else end + 1
            else:
                yield "text", page[at : less + 1], stack[-1]
                at = less + 1
            continue
        if less > at:
            yield "text", page[at:less], stack[-1]
        end = name.end()
        while end >= 0:
            m = _END_OR_QUOTE.search(page, end)
            if m is None:
                end = -1
            elif m[1] is None:
                end = m.start()
                break
            else:
                end = page.find(m[1], m.end()) + 1 or -1
        if end < 0:
            break
        at = end + 1
        tag = name[0].lower()
        if close:
            if tag in BLOCK:
                if counts.get(tag):
                    i = len(stack) - 1
                    while stack[i].tag != tag:
                        i -= 1
                    yield from shut(i)
            elif stack[-1].inline.get(tag):
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                yield from shut(i)
            continue
        scope = stack[-1].scope
        if tag in CLOSES_P and scope[0] >= 0:
            yield from shut(scope[0])
            scope = stack[-1].scope
        kind = KIND_OF.get(tag)
        if kind and scope[kind] >= 0:
            yield from shut(scope[kind])
        above = stack[-1]
        if tag in VOID:
            yield "void", tag, above
            continue
        attributes = page[name.end() : end]
        step, drop = (described if len(attributes) < 1000 else described.__wrapped__)(tag, attributes if _TELLING.search(attributes) else "")
        if tag == "header" and not above.inside:
            drop = HARD
        node = Node(tag, path_key(above.key, step) if step else above.key, above.depth + bool(step), drop, above)
        node.named = len(step) > len(tag) and bool(GOOD_NAME.search(step, len(tag)))
        if kind is not None or tag in BLOCK:
            places = list(node.scope)
            if tag in BLOCK:
                places[0] = -1
            for k, bars in BARS.items():
                if tag in bars:
                    places[k] = -1
            if kind is not None:
                places[kind] = len(stack)
            node.scope = tuple(places)
        counts[tag] = counts.get(tag, 0) + 1
        if tag not in BLOCK:
            node.inline[tag] = node.inline.get(tag, 0) + 1
        stack.append(node)
        yield "open", node
        if tag in RAW:
            raw_end = _RAW_END[tag].search(page, at)
            if raw_end is None:
                at = size
            else:
                end = page.find(">", raw_end.end())
                at = size if end < 0 else end + 1
            yield from shut(len(stack) - 1)
    yield from shut(1)


class Page:
    """A page's elements and blocks of text (element, text, characters in links) in order, without what is dropped."""

    def __init__(self, page: str):
        opened: list[Node] = []
        blocks: list[list[tuple[Node, str, bool]]] = [[]]
        link = hard = 0
        for kind, *what in events(page):
            if kind == "text":
                if not hard:
                    blocks[-1].append((what[1], html.unescape(what[0]) if "&" in what[0] else what[0], link > 0))
            elif kind == "void":
                if not hard and what[0] in ("br", "hr"):
                    blocks[-1].append((what[1], "\n", False))
                if what[0] == "hr":
                    blocks.append([])
            else:
                node = what[0]
                step = 1 if kind == "open" else -1
                if node.tag in BLOCK and blocks[-1]:
                    blocks.append([])
                link += step * (node.tag == "a")
                hard += step * (node.drop == HARD)
                if step == 1 and not hard:
                    opened.append(node)
        gone = _without_page(opened, blocks)
        self.nodes = [n for n in opened if id(n) not in gone]
        self.blocks = []
        for block in blocks:
            left = [x for x in block if id(x[0]) not in gone]
            text = " ".join("".join(t for _, t, _ in left).split())
            if text:
                first = next(n for n, t, _ in left if t.strip())
                self.blocks.append((first, text, min(len(text), sum(len(" ".join(t.split())) for _, t, linked in left if linked))))

    def scores(self) -> dict[int, tuple[float, int]]:
        """Score and depth of each container's path: text of the article's kind less other text, of which a part counts for the
        containers around; more if it has the title (h1) in it. A container in an article or main counts for the nearest of these, so that no wrapper inside wins
        alone and leaves out the headline and its siblings."""
        for node, text, links in self.blocks:
            good = max(0, len(text) - 2 * links) if node.block in TEXTUAL or len(text) >= LONG else 0
            node.good += good * (2 if node.block in HEADINGS else 1) - (len(text) - good)
        found: dict[int, tuple[float, int]] = {}
        for node in reversed(self.nodes):
            node.parent.titled = node.parent.titled or node.titled
            if node.tag in CONTAINERS:
                if node.good > 0 and (node.home is None or node.home is node):
                    score = node.good * WORTH.get(node.tag, 1.0) * (GOOD_WORTH if node.named else 1.0) * (TITLE_WORTH if node.titled else 1.0)
                    found[node.key] = found.get(node.key, (0.0, 0))[0] + score, node.depth
                node.parent.good += node.good * UPWARDS
            else:
                node.parent.good += node.good
        return found

    def text(self, key: int | None) -> str | None:
        """The blocks under the containers of this path that hold text of the article's kind; None if there is none. Without a path all blocks. To be called after scores()."""
        if key is None:
            return "\n".join(t for _, t, _ in self.blocks)
        inside: set[int] = set()
        for node in self.nodes:
            if id(node.parent) in inside or (node.key == key and node.tag in CONTAINERS and node.good > 0):
                inside.add(id(node))
        return "\n".join(t for n, t, _ in self.blocks if id(n) in inside) if inside else None


def _without_page(opened: list[Node], blocks: list) -> set[int]:
    """The elements to be dropped by their names, and all in them; not one that holds the page: nearly all text, or most of it where it is a form or has an article, a main or an h1 in it."""
    total = 0
    for block in blocks:
        for node, text, linked in block:
            if not linked:
                n = len(text.strip())
                total += n
                node.plain += n
    for node in reversed(opened):
        node.parent.plain += node.plain
        node.parent.tells = node.parent.tells or node.tells or node.tag in ("article", "main", "h1")
    gone: set[int] = set()
    for node in opened:
        if id(node.parent) in gone:
            gone.add(id(node))
        elif node.drop == SOFT and not (10 * node.plain > 9 * total or (2 * node.plain > total and (node.tells or node.tag == "form"))):
            gone.add(id(node))
    return gone


def best_path(scores: dict[int, tuple[float, int]]) -> int | None:
    """The path with the most; of equals the deepest, then the least key."""
    return min(scores, key=lambda k: (-scores[k][0], -scores[k][1], k)) if scores else None


def main_text(page: str | None, path: int | None) -> str:
    """The text under the containers of this path, block by block; by the page's own best container if it has none of them."""
    if not page:
        return ""
    read = Page(page)
    scores = read.scores()
    text = read.text(path) if path is not None else None
    return read.text(best_path(scores)) if text is None else text


def vote(page: Column) -> Column:
    """A page's vote: path and depth of its best container; null if it has none."""
    @F.pandas_udf("path long, depth int")
    def cast(pages: pd.Series) -> pd.DataFrame:
        rows = []
        for page in pages:
            scores = Page(page).scores() if page else {}
            best = best_path(scores)
            rows.append((best, scores[best][1]) if best is not None else (None, None))
        return pd.DataFrame(rows, columns=["path", "depth"], dtype=object)

    return cast(page)


def text_by_path(page: Column, path: Column) -> Column:
    @F.pandas_udf("string")
    def read(pages: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([main_text(page, None if pd.isna(path) else int(path)) for page, path in zip(pages, paths)], dtype=object)

    return read(page, path)


def host_of(url: Column) -> Column:
    """The host in lower case; empty if the URL is null or has none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def winning_paths(pages: DataFrame) -> DataFrame:
    """host, path: the path that is the best container's on most of a host's pages; of equals the deepest, then the least key. One row per host.

    Each page has one vote, so that the wrapper which is second best everywhere does not win by its nearness. Votes are counted
    before the shuffle: a host with a third of all pages is a row a task and path there."""
    cast = pages.select(host_of(F.col("url")).alias("host"), vote(F.col("html")).alias("v")).where("v.path is not null")
    sums = cast.groupBy("host", F.col("v.path").alias("path")).agg(F.count("*").alias("votes"), F.max("v.depth").alias("depth"))
    return sums.groupBy("host").agg(F.min(F.struct(-F.col("votes"), -F.col("depth"), "path"))["path"].alias("path"))


#: Hosts up to which their paths, 50 bytes each, are broadcast. Beyond, pages are joined by host, and Spark splits hot hosts.
HOSTS = 500_000


def extract(pages: DataFrame) -> DataFrame:
    """pages with a column main_text, in place of any of this name.

    A null or empty html gives the empty text. Pages with no URL share one host, ''. A page without its host's winning
    container is read by its own best one. Whole pages are read, in time linear in their length, however broken. Repeated rows
    stay; an empty table gives an empty result; other columns pass through, whatever their names."""
    host, path, at = unused(pages, "host", "path", "at")
    best = written(winning_paths(pages.select("url", "html")), "html-paths").toDF(host, path)
    if best.count() <= HOSTS:
        best = F.broadcast(best)
    keyed = pages.withColumn(at, host_of(F.col("url")))
    with_path = keyed.join(best, F.col(at) == F.col(host), "left")
    return with_path.withColumn("main_text", text_by_path(F.col("html"), F.col(path))).select(*[c for c in pages.columns if c != "main_text"], "main_text")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))
