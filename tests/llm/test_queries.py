"""The ten queries through the entry functions: column names, types, and values against plain Python that shares no code with the operators."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import DATA
from test_operators import ASSIGN, base_spans, brute_groups, brute_targets

import __spark_entry__ as entry

COLUMNS = {
    "op1_substring_dedup": {"doc_id": "bigint", "text": "string", "n_removed": "bigint"},
    "op2_secrets": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op3_html_extraction": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op4_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op5_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op6_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op7_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op8_media": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op9_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op10_ngram_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
}


@pytest.fixture(scope="module")
def results(spark):
    out = {}
    for key in COLUMNS:
        df = entry.queries()[key](spark, DATA)
        out[key] = (dict(df.dtypes), df.collect())
    return out


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.mark.parametrize("key", COLUMNS)
def test_columns(results, key):
    types, rows = results[key]
    assert {c: types.get(c) for c in COLUMNS[key]} == COLUMNS[key] and rows


def test_rows_are_whole(spark, results, texts):
    pages = {r.page_id for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for key, (_, rows) in results.items():
        want = pages if "page_id" in COLUMNS[key] else set(texts)
        assert Counter(r["page_id" if "page_id" in COLUMNS[key] else "doc_id"] for r in rows) == Counter(want)


def test_secrets(results, texts):
    names = ("assign", "access", "hex")
    for r in results["op2_secrets"][1]:
        base = base_spans(texts[r.doc_id])
        listed = [f"{names[k]}:{a}:{b}" for a, k, b in base]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        spans = [tuple(x.split(":")) for x in r.spans.split(",")] if r.spans else []
        assert set(listed) <= {":".join(x) for x in spans}
        starts = [int(a) for _, a, _ in spans]
        assert starts == sorted(starts) and all(int(b) <= len(texts[r.doc_id]) for _, _, b in spans)
    assert ASSIGN.search("api_key = 'abcdefghijkl'")


def test_pages(spark, results):
    html = {r.page_id: r.html or "" for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in results["op3_html_extraction"][1]:
        assert r.n_chars == len(r.text) and "<p" not in r.text
    by = defaultdict(list)
    for i, h in html.items():
        by[h].append(i)
    for r in results["op6_warc"][1]:
        raw = html[r.page_id].encode()
        first = max(by[html[r.page_id]])
        again = len(raw) >= 1000 and first != r.page_id
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", first if again else None)


def plain_words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_windows(items):
    """Windows of ten words of items (id, text), and the items that have them."""
    windows = defaultdict(set)
    for item, text in items:
        w = plain_words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(str(item))
    return windows


def plain_hits(text, windows):
    """Words under windows, and the windows' items."""
    w, hit, items = plain_words(text), set(), set()
    for n in {len(x) for x in windows}:
        for i in range(len(w) - n + 1):
            if found := windows.get(tuple(w[i : i + n])):
                hit |= set(range(i, i + n))
                items |= found
    return hit, items


def test_decontamination(spark, results, texts):
    windows = plain_windows((r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect())
    for r in results["op4_decontamination"][1]:
        hit, items = plain_hits(texts[r.doc_id], windows)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(plain_words(texts[r.doc_id])), len(hit), len(items), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def test_counts(results, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in results["op5_token_counts"][1]:
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)


def test_mix(spark, results, texts):
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    sizes, taken, most = Counter(), Counter(), Counter()
    for r in results["op7_mixing"][1]:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id])) and r.taken in (0, r.size, 2 * r.size)
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        most[source[r.doc_id]] = max(most[source[r.doc_id]], r.size)
    want = brute_targets(sizes)
    for r in results["op7_mixing"][1]:
        s = source[r.doc_id]
        assert abs(r.target - want[s]) < 1e-3 and r.source_size == sizes[s] and abs(taken[s] - r.target) <= most[s] / 2 + 1


def test_media(results, texts):
    seen = {}
    for r in results["op8_media"][1]:
        raw = texts[r.doc_id].encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        values = tuple(r)[1:]
        assert seen.setdefault(texts[r.doc_id], values) == values and r.media_bytes > r.payload_bytes


def test_languages(spark, results, texts):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    held = [r for r in results["op9_language_id"][1] if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in results["op9_language_id"][1])
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.9 * len(held)


def test_groups(results, texts):
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in results["op10_ngram_join"][1]) == brute_groups(sorted(texts.items()))


def test_substrings(results, texts):
    """Runs of two sentences by a splitter and an enumeration of their own, over the whole table."""
    cut = re.compile(r".*?(?:[.!?…]+(?=\s)\s+|\n\s*|\Z)", re.S)
    parts = {}
    for i, t in texts.items():
        own = [x for x in cut.findall(t) if x]
        out = []
        for x in own:
            if x.strip() or not out:
                out.append(x)
            else:
                out[-1] += x
        parts[i] = out
    key = lambda a, b: " ".join((a + " " + b).lower().split())
    first, gone = {}, defaultdict(set)
    for i in sorted(parts):
        for a, (x, y) in enumerate(zip(parts[i], parts[i][1:])):
            if first.setdefault(key(x, y), (i, a)) != (i, a):
                gone[i] |= {a, a + 1}
    for r in results["op1_substring_dedup"][1]:
        assert r.n_removed == len(gone[r.doc_id]) and (r.text or "") == "".join(x for a, x in enumerate(parts[r.doc_id]) if a not in gone[r.doc_id])
