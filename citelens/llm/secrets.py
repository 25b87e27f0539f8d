"""Secret scans in DataFrame functions only: fixed patterns, and sliding-window Shannon entropy over candidate strings."""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citelens.llm.shared import table

# The base patterns. Each takes the leftmost match, as long as it goes; what is too short is dropped afterwards.
# A short run of ACCESS or HEX holds no longer match, so there the length can stand in the pattern.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]{14,})"
HEX = r"([0-9a-f]{16,})"
BASE = (("assign", ASSIGN, 12), ("access", ACCESS, 18), ("hex", HEX, 16))
#: Every match that can be kept has one of these in it, so texts without them need no positions.
NEEDED = {"assign": r"(?i)(?:passw|secret|token|api_?key)", "access": r"AKIA[A-Z0-9]{14}", "hex": r"[0-9a-f]{16}"}


BASE64 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-"


@dataclass(frozen=True)
class CharacterClass:
    """Candidates are runs of an alphabet, of at least `window` characters; one is a secret if some window's entropy reaches `bits`."""

    name: str
    run: str
    window: int
    bits: float
    alphabet: str


#: Runs of letters alone are words, whatever their entropy: a candidate has to hold a digit and a letter.
CLASSES = (
    CharacterClass("hexwin", r"(?<![0-9A-Za-z+/_=-])(?=[A-F]*[0-9])(?=[0-9]*[A-F])[0-9A-F]{20,}+(?![0-9A-Za-z+/_=-])", 20, 3.0, BASE64[:16]),
    CharacterClass("b64win", r"(?<![0-9A-Za-z+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[0-9A-Za-z+/_=-]{24,}+", 24, 3.9, BASE64),
)
#: A candidate that matches is no secret: identifiers in a fixed form, sample values, counted-up alphabets.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|placeholder|changeme|dummy|sample|redacted",
    r"(?i)0123456789|abcdefghij|(.)\1{7}",
    r"(?i)^/?(?:[a-z]++[/_-])++[a-z]*+[0-9]{0,4}$",
)

SPAN = "array<struct<start:int,kind:int,end:int>>"
MATCHES = "array<struct<start:int,kind:int,end:int,own:string>>"
PIECES = "array<struct<gap:int,length:int,kept:boolean,own:string>>"


#: Matches are placed by running sums inside chunks of so many, so that a text of many matches needs no array that grows by one at each.
CHUNK = 128


def positions(text: Column, pattern: str, least: int, kind: int, group: int = 1) -> Column:
    """Matches (start, kind, end in code points; own: the matched string) of the pattern's leftmost non-overlapping matches whose group has at least so many characters."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    sized = F.transform(F.arrays_zip(gaps.alias("g"), whole.alias("w"), part.alias("p")), lambda x: F.struct(F.char_length(x["g"]).alias("gap"), F.coalesce(F.char_length(x["w"]), F.lit(0)).alias("length"), (F.char_length(x["p"]) >= least).alias("kept"), x["w"].alias("own")))

    def placed(pieces):
        chunks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(pieces), F.lit(1)), F.lit(CHUNK)), lambda i: F.slice(pieces, i, CHUNK))
        sums = F.transform(chunks, lambda c: F.struct(c.alias("c"), F.aggregate(c, F.lit(0), lambda n, x: n + x["gap"] + x["length"]).alias("n")))
        started = F.aggregate(sums, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<at:int,c:{PIECES}>>").alias("out")), lambda a, x: F.struct((a["at"] + x["n"]).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("at"), x["c"].alias("c")))).alias("out")), lambda a: a["out"])
        return F.flatten(F.transform(started, lambda x: F.aggregate(x["c"], F.struct(x["at"].alias("at"), F.array().cast(MATCHES).alias("spans")), step, lambda a: a["spans"])))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + x["length"]
        match = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["own"].alias("own"))
        return F.struct(end.alias("at"), F.when(x["kept"], F.concat(acc["spans"], F.array(match))).otherwise(acc["spans"]).alias("spans"))

    # An array of one binds the pieces, so that they are worked out once.
    return F.element_at(F.transform(F.array(sized), placed), 1)


def window_entropy(candidate: Column, window: int, alphabet: str = BASE64, enough: float | None = None) -> Column:
    """The highest Shannon entropy, in bits a character, of any window of so many characters; 0 for shorter strings.

    The counts of the alphabet's characters are one string with a character for each, and change by one character out and
    one in at each step: with the sum S of f(c) = c * log2(c) over the counts, the entropy is log2(n) - S / n, and one change
    of a count moves S by a difference of f. Characters beyond the alphabet are counted as one. Where enough is given, the
    scan rests at the first window that has so much."""
    rise = F.array(*[F.lit((c + 1) * log2(c + 1) - (c * log2(c) if c else 0.0)) for c in range(window + 1)])
    none = F.lit("0" * (len(alphabet) + 1))
    slots = F.transform(F.split(candidate, ""), lambda c: F.when(F.instr(F.lit(alphabet), c) > 0, F.instr(F.lit(alphabet), c)).otherwise(len(alphabet) + 1))

    def scanned(slot):
        # Step 2 k lets the character before the window of k out, step 2 k + 1 lets character k in.
        def step(acc, e):
            k = F.floor(e / 2).cast("int")
            goes = e % 2 == 0
            at = F.element_at(slot, F.when(goes, k - window).otherwise(k))
            return F.when(acc["done"] | (goes & (k <= window)), acc).otherwise(F.element_at(F.transform(F.array(F.struct(at.alias("at"), (F.ascii(F.substring(acc["counts"], at, F.lit(1))) - 48).alias("n"))), lambda x: moved(acc, x["at"], x["n"], goes, k)), 1))

        def moved(acc, at, n, goes, k):
            s = acc["s"] + F.when(goes, -F.element_at(rise, F.greatest(n, F.lit(1)))).otherwise(F.element_at(rise, F.least(n + 1, F.lit(window + 1))))
            counts = F.overlay(acc["counts"], F.char((n + F.when(goes, -1).otherwise(1) + 48).cast("long")), at, F.lit(1))
            best = F.when(~goes & (k >= window), F.greatest(acc["best"], F.lit(log2(window)) - s / window)).otherwise(acc["best"])
            done = best >= enough if enough is not None else F.lit(False)
            return F.struct(counts.alias("counts"), s.alias("s"), best.alias("best"), done.alias("done"))

        start = F.struct(none.alias("counts"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"), F.lit(False).alias("done"))
        return F.aggregate(F.sequence(F.lit(2), 2 * F.size(slot) + 1), start, step, lambda a: a["best"])

    return F.when(F.char_length(candidate) >= window, F.element_at(F.transform(F.array(slots), scanned), 1)).otherwise(0.0)


def wanted(c: CharacterClass, allowed):
    """The test of a candidate: not on the allow-list, and with a window of enough entropy."""
    def test(x):
        known = F.lit(False)
        for pattern in allowed:
            known = known | x["own"].rlike(pattern)
        return ~known & (window_entropy(x["own"], c.window, c.alphabet, c.bits) >= c.bits)

    return test


def spans_of(matches: Column) -> Column:
    return F.transform(matches, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))


def secret_spans(text: Column, classes=CLASSES, allowed=ALLOWED) -> Column:
    """All spans (start, kind, end), ordered. Entropy finds are added where they meet no base span."""
    none = F.array().cast(SPAN)
    base = F.array_sort(F.concat(*[F.when(text.rlike(NEEDED[name]), spans_of(positions(text, pattern, least, k))).otherwise(none) for k, (name, pattern, least) in enumerate(BASE)]))
    more = []
    for k, c in enumerate(classes, len(BASE)):
        more.append(F.when(text.rlike(c.run), spans_of(F.filter(positions(text, f"({c.run})", 1, k), wanted(c, allowed)))).otherwise(none))
    both = F.struct(base.alias("base"), F.concat(*more).alias("more"))
    # One more step binds the two arrays, so that they are not worked out anew for each span.
    bound = F.transform(F.array(both), lambda s: F.struct(s["base"].alias("base"), F.array_sort(F.concat(s["base"], F.filter(s["more"], lambda x: ~F.exists(s["base"], lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))))).alias("spans")))
    return F.element_at(bound, 1)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a struct column secrets (base, spans: arrays of start, kind, end), in place of any column of this name.

    A null text is empty and has none. Whole texts are scanned; a candidate's windows take time in proportion to its length.
    Spans of two entropy classes may be of one string. Equal rows get equal results and all stay; an empty
    table gives an empty result; other columns pass through."""
    return docs.withColumn("secrets", secret_spans(F.coalesce(F.col(text), F.lit(""))))


def redacted(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with each span, or run of overlapping spans, replaced by the mask; null stays null."""
    def step(acc, x):
        fresh = x["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mask))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.char_length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def listed(spans: Column, classes=CLASSES) -> Column:
    names = F.array(*[F.lit(name) for name, _, _ in BASE], *[F.lit(c.name) for c in classes])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    base, spans = F.col("secrets.base"), F.col("secrets.spans")
    of = lambda k: lambda x: x["kind"] == k
    counts = [F.size(F.filter(base, of(k))).cast("long").alias(f"n_{name}") for k, (name, _, _) in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: secrets are masked in the texts, and n_chars follows; every document stays."""
    found = docs.withColumn("text", redacted(F.col("text"), secret_spans(F.coalesce(F.col("text"), F.lit("")))["spans"]))
    return found.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast("long"))).select(*docs.columns)


def oracle() -> str:
    """The query as SQL. What its patterns lack there is tested afterwards: a run of an alphabet is taken whole, and a repeated character is listed out."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    own = "([0-9A-Za-z+/_=-]{%d,})"
    forms = [(k, pattern) for k, (_, pattern, _) in enumerate(BASE)] + [(len(BASE) + k, own % c.window) for k, c in enumerate(CLASSES)]
    found = " UNION ALL ".join(f"SELECT r, {k} AS kind, regexp_extract_all(t, {quoted(x)}) AS w, regexp_extract_all(t, {quoted(x)}, 1) AS p, regexp_split_to_array(t, {quoted(x)}) AS g FROM d" for k, x in forms)
    repeated = "|".join(("[" + c + "]" if c != "-" else "-") + "{8}" for c in sorted(set(BASE64.lower())))
    allowed = " AND ".join(f"NOT regexp_matches(w, {quoted(x.replace('(.)' + chr(92) + '1{7}', repeated).replace('++', '+').replace('*+', '*'))})" for x in ALLOWED)
    letters, fits = ("[A-F]", "[A-Za-z]"), ("regexp_full_match(w, '[0-9A-F]+')", "true")
    kept = " OR ".join(f"(kind = {len(BASE) + k} AND {fits[k]} AND regexp_matches(w, '[0-9]') AND regexp_matches(w, '{letters[k]}') AND list_max(list_transform(range(1, length(w) - {c.window - 2}), lambda i: list_aggregate(string_split(substr(w, i, {c.window}), ''), 'entropy'))) >= {c.bits} - 1e-9)" for k, c in enumerate(CLASSES))
    names = ", ".join(quoted(n) for n in (*(n for n, _, _ in BASE), *(c.name for c in CLASSES)))
    counts = ", ".join(f"CAST(count(*) FILTER (WHERE kind = {k}) AS BIGINT) AS n_{n}" for k, (n, _, _) in enumerate(BASE))
    listing = f"string_agg(concat([{names}][kind + 1], ':', start, ':', stop), ',' ORDER BY start, kind, stop)"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), m AS ({found}),
x AS (SELECT r, kind, unnest(w) AS w, unnest(p) AS p, unnest(g[1:len(w)]) AS g, unnest(range(1, len(w) + 1)) AS i FROM m WHERE len(w) > 0),
y AS (SELECT r, kind, w, p, CAST(sum(length(g) + length(w)) OVER (PARTITION BY r, kind ORDER BY i) AS BIGINT) AS stop FROM x),
b AS (SELECT r, kind, stop - length(w) AS start, stop FROM y WHERE kind < {len(BASE)} AND length(p) >= [{', '.join(str(n) for _, _, n in BASE)}][kind + 1]),
c AS (SELECT r, kind, stop - length(w) AS start, stop FROM y WHERE kind >= {len(BASE)} AND {allowed} AND ({kept})),
s AS (SELECT * FROM b UNION ALL SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.r = c.r AND b.start < c.stop AND c.start < b.stop)),
n AS (SELECT r, {counts}, {listing} FILTER (WHERE kind < {len(BASE)}) AS base, {listing} AS spans FROM s GROUP BY r)
SELECT doc_id, {', '.join(f'coalesce(n_{n}, 0) AS n_{n}' for n, _, _ in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN n USING (r)"""


ORACLE_SQL = oracle()
