"""N-gram Jaccard join: neighbourhoods of documents that share shingles, cut into Voronoi regions by pivot documents, with triangle-inequality windows, recursion and exact leaves.

The distance is d = 1 - |x & y| / |x | y|, and documents link within RADIUS. Texts are at distance 1 from nearly all others,
where pivots cannot tell them apart, so the space is first cut where nothing links:

1. Neighbourhoods, by a prefix filter: shingles have one global order, hot ones last. Of two documents that link, the first
   shingle that both have is among the first n - ceil(0.8 n) + 1 of each. Members of such a cell whose sizes or places rule
   a link out leave it, and those whose sketches (how much of a set lies in each part of the hash space) do. What is left
   are candidate links; their components are the neighbourhoods. Hot cells connect their members without a test.
2. A neighbourhood is joined in one task if it is small. A large one is cut by pivots, which are some of its documents: each
   document goes to the region of its nearest pivot, and to those of other pivots q where a document y of q may be within
   the radius: d(x, q) <= d(x, own pivot) + 2 r, and d(x, q) <= r + the radius of q's region. Documents at distance 1 from
   every pivot are one region more, which documents at 1 - r or more from their own pivot are copied to. Regions are cut
   again by pivots of their own until they are small, in Spark while they are larger than a task, then inside the task where
   that leaves half of the pairs at most.
3. Documents that link with a pivot, and with pivots that such links connect, are known to be of one component. Where they are
   half of a region, and in regions that do not shrink, only the others are held against all, in blocks.
4. Leaves test pairs exactly, on words, leaving out pairs that are in one component already. Links give components.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citelens.llm.shared import bounded, components, filter_of, forget, small_batches, table, unused, written

WORDS = 5
RADIUS = 0.2
#: A set's sketch has a part for each 8 of its shingles or fewer, 64 parts at least; with fewer, sets that share nothing look near.
PER_PART = 8
#: Shingles of more than a 1/HOT_SHARE of the documents, and more than HOT_LEAST of them, come last in the order. The list of them
#: is a hint that makes cells small; links are found under any order, so its bound loses none.
HOT_SHARE, HOT_LEAST, HOT_MOST = 2000, 32, 1 << 18
#: Shingles that a task counts at a time.
COUNTED = 1 << 21
#: A task forgets which sets it has met after so many, and then deals out the cells of one of them again.
SEEN = 1 << 18
#: Shingles that one task joins; documents whose texts are fetched by a broadcast join, above which a filter comes before the join.
BLOCK, BROADCAST = 2_000_000, 500_000
#: Members of a cell of which the sketches are held against each other; a larger one is connected without.
WHOLE_CELL = 4096
#: Pivots of a region in Spark and in a task, and documents that are tested without pivots.
PIVOTS, TASK_PIVOTS, LEAF = 16, 8, 64
#: In a task, shingles of at least a 1/DENSE of a region's documents are columns of a matrix: of BLOCK shingles it has DENSE * BLOCK numbers at most.
#: Documents tested at a time, and numbers that such a test holds at once.
DENSE, TESTED, AT_ONCE = 12, 256, 2_000_000
#: A region that in Spark keeps more than this share of the one it was cut from does not shrink; one of which this share is of one component by its pivots is a ball.
SHRINKS, BALL, DEEPEST = 0.8, 0.5, 12

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTES = _rng.integers(1, 1 << 63, size=256, dtype=np.uint64) * _U(2) + _U(1)
_BYTES[[9, 10, 11, 12, 13, 32]] = 0
_TURN = _U(0x9FB21C651E98DF25)
_PLACES = np.ones(1, dtype=np.uint64)
_FIVE = _rng.integers(1, 1 << 63, size=(WORDS, WORDS), dtype=np.uint64) * _U(2) + _U(1)
_GAP = np.zeros(256, dtype=bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
#: A class is named by 48 bits of its digest where it is only a candidate; two of one name are candidates for the same.
_NAME = (1 << 48) - 1


def mixed(h: np.ndarray) -> np.ndarray:
    """Each bit of the result depends on each bit of the input."""
    h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
    h = (h ^ (h >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


def places(n: int) -> np.ndarray:
    global _PLACES
    if n > len(_PLACES):
        more = np.full(max(n, 1 << 12), _TURN, dtype=np.uint64)
        more[0] = 1
        _PLACES = np.multiply.accumulate(more)
    return _PLACES


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct 5-word shingles; equal in all processes."""
    data = np.frombuffer(text.encode("utf-8").lower(), dtype=np.uint8) if text else np.zeros(0, np.uint8)
    gap = _GAP[data]
    begins = ~gap
    begins[1:] &= gap[:-1]
    first = np.flatnonzero(begins)
    if not len(first):
        return np.zeros(0, dtype=np.int64)
    lengths = np.diff(np.append(first, len(data)))
    head = int(first[0])
    at = np.arange(len(data) - head) - np.repeat(first - head, lengths)
    words = mixed(np.add.reduceat(_BYTES[data[head:]] * places(int(lengths.max()))[at], first - head))
    n = min(WORDS, len(words))
    h = words[: len(words) - n + 1] * _FIVE[n - 1, 0]
    for i in range(1, n):
        h = (h ^ (h >> _U(29))) * _TURN + words[i : len(words) - n + 1 + i] * _FIVE[n - 1, i]
    return np.unique(mixed(h).view(np.int64))


def digest_of(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def prefix_length(n: int) -> int:
    return n + (-4 * n) // 5 + 1 if n else 0


def prefix(s: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, int]:
    """The shingles whose cells the document goes to, in the global order, and how many of them are cold."""
    k = prefix_length(len(s))
    if not len(hot):
        return s[:k], k
    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
    late = hot[at] == s
    cold = s[~late]
    return (cold[:k], k) if len(cold) >= k else (np.concatenate((cold, s[late][: k - len(cold)])), len(cold))


def sketch(s: np.ndarray) -> np.ndarray:
    """How much of the set lies in each part of the hash space, 255 standing for more. The sum of two sketches' differences is at most the sets' own."""
    bits = max(6, int(np.ceil(np.log2(max(1, len(s)) / PER_PART))))
    return np.minimum(np.bincount((s.view(np.uint64) >> _U(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8)


def hot_shingles(docs: DataFrame) -> np.ndarray:
    """Common shingles, from counts over all texts. Each task counts in bounded memory: what it has met once is forgotten now and then."""
    def counted(batches):
        held, kept_s, kept_c, size, seen = [], np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0

        def settle():
            s = np.sort(np.concatenate(held)) if held else np.zeros(0, np.int64)
            edge = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
            c = np.diff(np.append(edge, len(s)))
            often = c > 1
            s, c = np.concatenate((kept_s, s[edge][often])), np.concatenate((kept_c, c[often]))
            keys, where = np.unique(s, return_inverse=True)
            return keys, np.bincount(where, weights=c, minlength=len(keys)).astype(np.int64)

        for batch in bounded(batches):
            for text in batch.column(0).to_pylist():
                held.append(shingle_set(text))
                size += len(held[-1])
                seen += 1
                if size > COUNTED:
                    (kept_s, kept_c), held, size = settle(), [], 0
        kept_s, kept_c = settle()
        often = kept_c >= max(3, seen // (2 * HOT_SHARE))
        yield pa.RecordBatch.from_arrays([pa.array(kept_s[often]), pa.array(kept_c[often])], names=["s", "c"])

    least = max(HOT_LEAST, docs.count() // HOT_SHARE) // 2
    sums = docs.select("text").mapInArrow(counted, "s long, c long").groupBy("s").agg(F.sum("c").alias("c")).where(F.col("c") >= least)
    with small_batches(docs.sparkSession):
        common = sums.orderBy(F.desc("c"), "s").limit(HOT_MOST).collect()
    return np.sort(np.array([r.s for r in common], dtype=np.int64))


def sketched(docs: DataFrame, hot) -> DataFrame:
    """doc_id, text_key, n, digest of the set, cid (48 bits of it), cells, how many of them are cold, sketch.

    Without words n is 0 and the rest null. Cells and sketch are null where the task has met the set before, and cells for
    sets of 1 to 3 shingles, which link with equal sets only."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def made(batches):
        order, seen = hot.value, set()
        for batch in bounded(batches):
            rows = []
            for text in batch.column(2).to_pylist():
                s = shingle_set(text)
                if not len(s):
                    rows.append((0, None, None, None, None, None))
                    continue
                d = digest_of(s)
                cid = int.from_bytes(d[:6], "big")
                if d in seen:
                    rows.append((len(s), d, cid, None, None, None))
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(d)
                own, cold = prefix(s, order) if len(s) > 3 else (None, 0)
                rows.append((len(s), d, cid, own, cold, sketch(s).tobytes()))
            n, digest, cid, cells, cold, marks = zip(*rows) if rows else ((),) * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(cid, pa.int64()), pa.array(cells, pa.list_(pa.int64())), pa.array(cold, pa.int32()), pa.array(marks, pa.binary())], names=["doc_id", "text_key", "n", "digest", "cid", "cells", "cold", "sketch"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(made, f"doc_id {kind}, text_key long, n long, digest binary, cid long, cells array<long>, cold int, sketch binary")


# Neighbourhoods ------------------------------------------------------------------------------------------------------

def packed(n: Column, at: Column, cid: Column) -> Column:
    """A cell's row in one number that sorts by size: 10 bits of size (on a log scale, 64 steps to a doubling), 6 of place, 48 of name."""
    size = F.least(F.floor(F.log2(n) * 64), F.lit(1023)) - 512
    place = F.floor(at * 320 / (n + 5))
    return F.shiftleft(size.cast("long"), 54) + F.shiftleft(place.cast("long"), 48) + cid


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether two packed members of a cell cannot link with this as their first common shingle: what comes before it is in one of
    the two only, what comes after differs by the lengths of the rests at least, and links differ in a ninth of both sizes at most."""
    size = lambda v: (v >> 54) + 512
    low = lambda v: np.exp2(size(v) / 64) * (1 - 1e-9)
    high = lambda v: np.where(size(v) >= 1023, np.inf, np.exp2((size(v) + 1) / 64) * (1 + 1e-9))
    i, j = ((v >> 48 & 63) / 320 * low(v) for v in (x, y))
    most = (high(x) + high(y)) / 9
    return (low(x) - high(y) + 2 * j > most) | (low(y) - high(x) + 2 * i > most) | (i + j > most)


def cell_groups(batches):
    """From sorted (shingle, packed): (pivot, member) names of the groups of each cell whose sizes make a chain. Holds one group's pivot, never a cell."""
    last_s = last_x = pivot = None
    shown = True
    for batch in batches:
        s, x = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if last_s is not None:
            s, x = np.append(last_s, s), np.append(last_x, x)
        if len(s) < 1 + (last_s is not None):
            continue
        fresh = np.append(True, (s[1:] != s[:-1]) | (x[1:] != x[:-1]))
        s, x = s[fresh], x[fresh]
        size = (x >> 54) + 512
        start = np.append(last_s is None, (s[1:] != s[:-1]) | ((size[1:] - size[:-1] >= 22) & (size[:-1] < 1023)))
        name = x & _NAME
        heads = np.flatnonzero(start)
        run = np.cumsum(start) - 1
        ends = np.append(heads[1:], len(s))
        keep = ~start
        if last_s is not None:
            keep[0] = False  # the row held from the batch before has been dealt with
        two = np.flatnonzero((ends - heads == 2) & (ends < len(s)))
        if len(two):
            keep[heads[two] + 1] = ~apart(x[heads[two]], x[heads[two] + 1])
        own = name[heads]
        pivots = np.where(run >= 0, own[np.maximum(run, 0)], pivot if pivot is not None else 0) if len(heads) else np.full(len(s), pivot)
        out_p, out_x = pivots[keep], name[keep]
        with_rows = np.unique(run[keep])
        known = with_rows[with_rows >= 0]
        out_p, out_x = np.append(out_p, own[known]), np.append(out_x, own[known])
        if (with_rows < 0).any() and not shown:
            out_p, out_x, shown = np.append(out_p, pivot), np.append(out_x, pivot), True
        if len(heads):
            shown = bool(len(known)) and known[-1] == len(heads) - 1
            pivot = int(own[-1])
        last_s, last_x = s[-1], x[-1]
        yield pa.RecordBatch.from_arrays([pa.array(out_p.astype(np.int64)), pa.array(out_x.astype(np.int64))], names=["p", "x"])


def grouped(batches, keys: int):
    """Runs of rows with equal first columns, each as a table. Runs may span batches; a row is looked at once."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, dtype=bool)
        for a in ids:
            change[1:] |= a[1:] != a[:-1]
        now = tuple(a[0] for a in ids)
        if held and now != last:
            yield pa.Table.from_batches(held)
            held = []
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(edges[:-2], edges[1:-1]):
            yield pa.Table.from_batches([*held, batch.slice(a, b - a)])
            held = []
        held.append(batch.slice(edges[-2]))
        last = tuple(a[-1] for a in ids)
    if held:
        yield pa.Table.from_batches(held)


def spanning(m: int, near) -> list[tuple[int, int]]:
    """Edges that connect what near(i, others) connects: components grow from their newest members, and what is in one is not looked at again."""
    free, edges = np.arange(m), []
    while len(free) > 1:
        front, free = [int(free[0])], free[1:]
        while front and len(free):
            i = front.pop()
            met = near(i, free)
            edges += [(i, j) for j in free[met].tolist()]
            front += free[met].tolist()
            free = free[~met]
    return edges


def sketch_edges(n: np.ndarray, marks: list[bytes]) -> list[tuple[int, int]]:
    """Edges between members that may be within the radius, by their sizes and sketches. Sets within it differ in size by a quarter
    at most, so their sketches are of one fineness or of neighbouring ones; the finer is folded."""
    fine = np.array([len(k) for k in marks])
    row = np.zeros(len(n), dtype=np.int64)
    own, folded = {}, {}
    for parts in np.unique(fine).tolist():
        at = np.flatnonzero(fine == parts)
        row[at] = np.arange(len(at))
        own[parts] = np.frombuffer(b"".join(marks[i] for i in at), dtype=np.uint8).reshape(len(at), parts).astype(np.int16)
        folded[parts] = np.minimum(own[parts].reshape(len(at), parts // 2, 2).sum(axis=2), 255)

    def near(i: int, others: np.ndarray) -> np.ndarray:
        fits = (4 * n[i] <= 5 * n[others]) & (4 * n[others] <= 5 * n[i])
        parts = int(fine[i])
        for theirs, mine, side in ((parts, own[parts], own), (2 * parts, own[parts], folded), (parts // 2, folded[parts], own)):
            at = np.flatnonzero(fits & (fine[others] == theirs))
            for k in range(0, len(at), step := max(1, (1 << 22) // parts)):
                part = at[k : k + step]
                off = np.abs(side[theirs][row[others[part]]] - mine[row[i]]).sum(axis=1, dtype=np.int64)
                fits[part] = 9 * off <= n[i] + n[others[part]]
        return fits

    return spanning(len(n), near)


def candidate_edges(batches):
    """Of sorted (p, x, n, sketch): candidate links of each group."""
    for t in grouped(batches, 1):
        if t.num_rows < 2:
            continue
        names = t.column(1).to_numpy()
        if t.num_rows <= WHOLE_CELL:
            edges = sketch_edges(t.column(2).to_numpy(), t.column(3).to_pylist())
            if not edges:
                continue
            a, b = np.array(edges).T
            a, b = names[a], names[b]
        else:
            a, b = names, np.full(len(names), t.column(0)[0].as_py())
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def neighbourhoods(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """region, digest, rep, n of the classes that may link with another, as a written table."""
    dealt = rows.where("cells is not null").select("n", "cid", "cold", F.posexplode("cells").alias("at", "s"))
    cold = dealt.where("at < cold").select("s", packed(F.col("n"), F.col("at"), F.col("cid")).alias("x"))
    groups = cold.repartition("s").sortWithinPartitions("s", "x").mapInArrow(cell_groups, "p long, x long").distinct()
    marked = groups.join(classes.select(F.col("cid").alias("x"), "n", "sketch"), "x").select("p", "x", "n", "sketch")
    edges = marked.repartition("p").sortWithinPartitions("p", "n", "x").mapInArrow(candidate_edges, "a long, b long")
    # Of a hot cell there is no list: its least member is found by partial sums, and the others point at it. There are HOT_MOST hot shingles at most.
    hot = dealt.where("at >= cold").select("s", "cid")
    first = F.broadcast(hot.groupBy("s").agg(F.min("cid").alias("b")))
    edges = edges.unionByName(hot.join(first, "s").select(F.col("cid").alias("a"), "b").where("a <> b").distinct())
    stars = components(edges, name="join-neighbours")
    return written(stars.join(classes.select("cid", "digest", "rep", "n"), F.col("node") == F.col("cid")).select(F.col("root").alias("region"), "digest", "rep", "n"), "join-members")


# Regions -------------------------------------------------------------------------------------------------------------

def linked(common, n_a, n_b):
    """100 * common >= 80 * union."""
    return 9 * common >= 4 * (n_a + n_b)


def word_sets(texts: list[str]) -> list[np.ndarray]:
    """The shingle sets of some texts as sorted numbers; equal numbers are equal words within this list, without hashing. A text of fewer words than a shingle has, which links with no other, has a number of its own."""
    names: dict[bytes, int] = {}
    words = [[names.setdefault(w, len(names)) for w in t.encode("utf-8").lower().split()] for t in texts]
    long = [i for i, w in enumerate(words) if len(w) >= WORDS]
    out = [np.array([-1 - i], dtype=np.int64) for i in range(len(texts))]
    if not long:
        return out
    token = np.concatenate([np.array(words[i], dtype=np.int64) for i in long])
    count = len(token) - WORDS + 1

    def joined(a, b):
        """Numbers of pairs, closed up."""
        _, number = np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)
        return number

    if len(names) ** WORDS < 1 << 62:
        five = token[:count]
        for k in range(1, WORDS):
            five = five * len(names) + token[k : k + count]
    else:
        two = joined(token[:-1], token[1:])
        four = joined(two[:-2], two[2:])
        five = joined(four[:count], token[WORDS - 1 :])
    at = 0
    for i in long:
        out[i] = np.unique(five[at : at + len(words[i]) - WORDS + 1])
        at += len(words[i])
    return out


def cells_of(far: np.ndarray, radius: float = RADIUS) -> list[np.ndarray]:
    """Voronoi regions with windows: for distances of members (rows) to pivots (columns), the members of each region. The last region
    is that of the members at distance 1 from all. Any two members within the radius are together in a region."""
    k = far.shape[1]
    near = far.min(axis=1)
    home = np.where(near < 1, far.argmin(axis=1), -1)
    out = []
    for q in range(k):
        own = home == q
        reach = far[own, q].max() if own.any() else -1.0
        out.append(np.flatnonzero(own | ((home > q) & (far[:, q] <= np.minimum(near + 2 * radius, reach + radius) + 1e-9))))
    outer = home == -1
    out.append(np.flatnonzero(outer | (near >= 1 - radius - 1e-9)) if outer.any() else np.zeros(0, np.int64))
    return out


class Region:
    """Sets joined exactly: label is, for each, the least index of its component. Sets that are known to be linked may share a label from the start."""

    def __init__(self, sets: list[np.ndarray], label: np.ndarray | None = None):
        m = len(sets)
        self.n = np.array([len(s) for s in sets], dtype=np.int64)
        self.label = np.arange(m) if label is None else label
        _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(m), self.n)
        keep = times[column] > 1
        columns, column = np.unique(column[keep], return_inverse=True)
        owner, times = owner[keep], times[times > 1]
        # Columns of many members are multiplied, which is one product for all; those of few are looked up.
        many = times * DENSE >= m
        self.dense = np.zeros((m, int(many.sum())), dtype=np.float32)
        wide = many[column]
        self.dense[owner[wide], (np.cumsum(many) - 1)[column[wide]]] = 1
        owner, self.column = owner[~wide], column[~wide]
        self.row_at = np.searchsorted(owner, np.arange(m + 1))
        by_column = np.argsort(self.column, kind="stable")
        self.col_at, self.posting = np.searchsorted(self.column[by_column], np.arange(len(columns) + 1)), owner[by_column]
        self.looked_up = np.append(0, np.cumsum(times[self.column]))[self.row_at]

    def common(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        out = (self.dense[rows] @ self.dense[others].T).astype(np.int64)
        cost = self.looked_up[rows + 1] - self.looked_up[rows] + len(self.n)
        for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(np.cumsum(cost) // AT_ONCE)) + 1):
            own = [self.column[self.row_at[r] : self.row_at[r + 1]] for r in rows[part].tolist()]
            met = np.concatenate(own)
            if not len(met):
                continue
            lengths = self.col_at[met + 1] - self.col_at[met]
            at = np.arange(lengths.sum()) + np.repeat(self.col_at[met] - np.cumsum(lengths) + lengths, lengths)
            place = np.repeat(np.repeat(np.arange(len(part)), [len(c) for c in own]), lengths) * len(self.n) + self.posting[at]
            out[part] += np.bincount(place, minlength=len(part) * len(self.n)).reshape(len(part), -1)[:, others]
        return out

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        """Each member of a and that of b at its place are of one component."""
        a, b = self.label[a], self.label[b]
        into = np.arange(len(self.n))
        while (differ := into[a] != into[b]).any():
            a, b = into[a[differ]], into[b[differ]]
            np.minimum.at(into, np.maximum(a, b), np.minimum(a, b))
            while (into[into] != into).any():
                into = into[into]
        self.label = into[self.label]

    def join(self, members: np.ndarray, depth: int = 0) -> None:
        """Cut by pivots, and again each region, where that leaves half of the pairs at most; windows that overlap more make more pairs at each depth."""
        if len(np.unique(self.label[members])) < 2:
            return
        if len(members) <= LEAF or depth > DEEPEST:
            return self.test(members)
        pivots = members[np.linspace(0, len(members) - 1, TASK_PIVOTS).astype(int)]
        both = self.common(pivots, members)
        far = (1 - both / (self.n[pivots][:, None] + self.n[members][None, :] - both)).T
        i, j = np.nonzero(linked(both, self.n[pivots][:, None], self.n[members][None, :]))
        self.unite(pivots[i], members[j])
        cells = cells_of(far)
        if 2 * sum(len(cell) ** 2 for cell in cells) > len(members) ** 2:
            return self.test(members)
        for cell in cells:
            self.join(members[cell], depth + 1)

    def test(self, members: np.ndarray) -> None:
        """All pairs but those whose sizes rule a link out and those that are in one component already: by size, some members at a time
        against those of at least their size. The largest component comes apart from the rest, with which alone it is tested."""
        labels, at, sizes = np.unique(self.label[members], return_inverse=True, return_counts=True)
        main = at == sizes.argmax()
        rest, main = (part[np.argsort(self.n[part], kind="stable")] for part in (members[~main], members[main]))
        for first, second in ((rest, rest), (rest, main)):
            step = max(1, min(TESTED, AT_ONCE // max(1, len(second))))
            for k in range(0, len(first), step):
                rows = first[k : k + step]
                low = self.n[rows[0]] if first is second else -(-4 * self.n[rows[0]] // 5)
                a, b = np.searchsorted(self.n[second], [low, 5 * self.n[rows[-1]] // 4 + 1])
                others = second[a:b]
                if (self.label[rows] == self.label[rows[0]]).all():
                    others = others[self.label[others] != self.label[rows[0]]]
                if len(others):
                    i, j = np.nonzero(linked(self.common(rows, others), self.n[rows][:, None], self.n[others][None, :]))
                    self.unite(rows[i], others[j])


def join_region(sets: list[np.ndarray], core: np.ndarray | None = None) -> np.ndarray:
    """For each set the least index of its component. Sets marked as core are known to be of one."""
    label = np.arange(len(sets))
    if core is not None and core.any():
        label[core] = np.flatnonzero(core)[0]
    if len(sets) == 2:
        if linked(len(np.intersect1d(*sets, assume_unique=True)), len(sets[0]), len(sets[1])):
            label[1] = label[0]
        return label
    region = Region(sets, label)
    region.join(np.arange(len(sets)))
    return region.label


def region_links(batches):
    """Of sorted (region, digest, text, core): a link from each member to the least of its component, itself included, where there is another."""
    for t in grouped(batches, 1):
        own = {d: (text, core) for d, text, core in zip(*(t.column(i).to_pylist() for i in (1, 2, 3))) if digest_of(shingle_set(text)) == d}
        if len(own) < 2:
            continue
        names = sorted(own)
        label = join_region(word_sets([own[d][0] for d in names]), np.array([own[d][1] for d in names], dtype=bool))
        shared = np.bincount(label, minlength=len(names))[label] > 1
        if shared.any():
            a, b = zip(*((names[i], names[label[i]]) for i in np.flatnonzero(shared).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in (a, b)], names=["a", "b"])


def with_texts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """members (with digest, rep) and the text of a document of that id; of several with one id the reader picks by digest."""
    ids, docs = members.withColumnRenamed("rep", "__rep"), docs.select("doc_id", "text")
    if members.count() <= BROADCAST:
        ids = F.broadcast(ids)
    else:
        docs = docs.where(filter_of(ids.select(F.xxhash64("__rep")))(F.xxhash64("doc_id")))
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("__rep"))).where("text is not null").drop("doc_id", "__rep")


def leaf_links(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Links a, b of regions that one task holds, from members (region, digest, rep, core)."""
    texts = with_texts(docs, members.select("region", "digest", "rep", "core")).select("region", "digest", "text", "core")
    return texts.repartition("region").sortWithinPartitions("region").mapInArrow(region_links, "a binary, b binary")


def main_component(masks: list[tuple[int, int]]) -> int:
    """Of (pivots that a document links with, as bits; shingles): the pivots of the heaviest component that such documents connect."""
    parts: list[int] = []
    for mask in {m for m, _ in masks if m}:
        for part in [p for p in parts if p & mask]:
            parts.remove(part)
            mask |= part
        parts.append(mask)
    return max(parts, key=lambda p: (sum(n for m, n in masks if m & p), -p), default=0)


def measured(batches):
    """Of sorted (region, salt, kind, digest, text, n), pivots being of kind 0: each document's distances to the region's pivots, and which of them it links with."""
    at, pivots = None, {}
    for batch in bounded(batches, 200):
        rows = batch.to_pylist()
        a = 0
        while a < len(rows):
            key = (rows[a]["region"], rows[a]["salt"])
            if key != at:
                at, pivots = key, {}
            b = a
            while b < len(rows) and (rows[b]["region"], rows[b]["salt"]) == key:
                b += 1
            own = [r for r in rows[a:b] if digest_of(shingle_set(r["text"])) == r["digest"]]
            a = b
            pivots |= {r["digest"]: r["text"] for r in own if not r["kind"]}
            members = [r for r in own if r["kind"]]
            if not members:
                continue
            order = sorted(pivots)
            sets = word_sets([*(pivots[d] for d in order), *(r["text"] for r in members)])
            out = []
            for r, s in zip(members, sets[len(order) :]):
                both = np.array([len(np.intersect1d(s, p, assume_unique=True)) for p in sets[: len(order)]])
                size = np.array([len(p) for p in sets[: len(order)]])
                own = np.flatnonzero(linked(both, size, len(s))).tolist()
                out.append((r["region"], r["digest"], r["rep"], len(s), (1 - both / (size + len(s) - both)).tolist(), [order[k] for k in own], sum(1 << k for k in own)))
            names = ["region", "digest", "rep", "n", "far", "links", "mask"]
            kinds = [pa.int64(), pa.binary(), batch.schema.field("rep").type, pa.int64(), pa.list_(pa.float64()), pa.list_(pa.binary()), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def cut_by_pivots(docs: DataFrame, members: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """One round for large regions (region, digest, rep, n, size): links with pivots, and the regions that come of it, with core (known to be of one
    component there) and the size of the region before. A ball comes out as it is, with its core."""
    kind = members.schema["rep"].dataType.simpleString()
    salts = F.ceil(F.col("size") / BLOCK).cast("int")
    first = Window.partitionBy("region").orderBy(F.xxhash64("digest", F.lit(depth)), "digest")
    pivots = members.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= PIVOTS)
    pivots = pivots.select("region", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("kind"), "digest", "rep")
    every = members.select("region", F.pmod(F.xxhash64("digest"), salts).cast("int").alias("salt"), F.lit(1).alias("kind"), "digest", "rep")
    texts = with_texts(docs, pivots.unionByName(every).withColumn("id", F.col("rep")))
    routed = texts.select("region", "salt", "kind", "digest", F.col("id").alias("rep"), "text").repartition("region", "salt").sortWithinPartitions("region", "salt", "kind")
    far = written(routed.mapInArrow(measured, f"region long, digest binary, rep {kind}, n long, far array<double>, links array<binary>, mask long"), "join-distances")

    @F.pandas_udf("long")
    def main(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: main_component([(e["mask"], e["n"]) for e in x]))

    weights = far.groupBy("region", "mask").agg(F.sum("n").alias("n")).groupBy("region").agg(F.collect_list(F.struct("mask", "n")).alias("masks"), F.sum("n").alias("before"))
    weights = weights.select("region", "before", "masks", main("masks").alias("main"))
    held_by = F.aggregate(F.filter("masks", lambda x: x["mask"].bitwiseAND(F.col("main")) != 0), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    regions = written(weights.select("region", "before", "main", (held_by >= BALL * F.col("before")).alias("ball")), "join-balls")
    near = F.array_min("far")
    placed = far.withColumn("near", near).withColumn("home", F.when(near < 1, F.array_position("far", near).cast("int") - 1).otherwise(-1))
    placed = placed.join(regions, "region")
    balls = placed.where("ball").select(F.xxhash64("region", F.lit("ball"), F.lit(depth)).alias("region"), "digest", "rep", "n", (F.col("mask").bitwiseAND(F.col("main")) != 0).alias("core"), "before")
    placed = placed.where("not ball")
    radii = placed.groupBy("region", "home").agg(F.max("near").alias("r")).groupBy("region").agg(F.map_from_entries(F.collect_list(F.struct("home", "r"))).alias("radii"))
    held = placed.join(radii, "region")

    def goes(q):
        reach = F.try_element_at("radii", q)
        window = (F.col("home") > q) & (F.element_at("far", q + 1) <= F.least(F.col("near") + 2 * RADIUS, reach + RADIUS) + 1e-9)
        return (F.col("home") == q) | F.coalesce(window, F.lit(False))

    inner = F.filter(F.sequence(F.lit(0), F.size("far") - 1), goes)
    outer = F.try_element_at("radii", F.lit(-1)).isNotNull() & ((F.col("home") == -1) | (F.col("near") >= 1 - RADIUS - 1e-9))
    cells = F.concat(inner, F.when(outer, F.array(F.lit(-1))).otherwise(F.array().cast("array<int>")))
    core = F.coalesce(F.when(F.col("q") >= 0, F.element_at("far", F.greatest(F.col("q"), F.lit(0)) + 1) <= RADIUS - 1e-9), F.lit(False))
    new = held.select("region", "digest", "rep", "n", "far", "before", F.explode(cells).alias("q")).select(F.xxhash64("region", "q", F.lit(depth)).alias("region"), "digest", "rep", "n", core.alias("core"), "before")
    new = written(new.unionByName(balls), "join-regions")
    links = written(far.select(F.col("digest").alias("a"), F.explode("links").alias("b")).where("a <> b"), "join-pivot-links")
    forget(far)
    return links, new


def block_members(members: DataFrame) -> DataFrame:
    """Balls (region, digest, rep, n, core) in blocks, a pair of blocks being a region: documents outside of the core with each other, and with the core."""
    half = max(1, BLOCK // 2)
    sums = members.groupBy("region").agg(*[F.ceil(F.sum(F.when(F.col("core") == c, F.col("n")).otherwise(0)) / half).cast("int").alias(k) for c, k in ((False, "rests"), (True, "cores"))])
    m = members.join(sums, "region").withColumn("i", F.pmod(F.xxhash64("digest", F.lit("block")), F.greatest(F.lit(1), F.when(F.col("core"), F.col("cores")).otherwise(F.col("rests")))).cast("int"))
    upto = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    name = lambda what, a, b: F.xxhash64("region", F.lit(what), a, b)
    with_core = F.transform(upto("cores"), lambda j: name("core", F.col("i"), j))
    with_rest = F.transform(upto("rests"), lambda j: name("rest", F.least(F.col("i"), j), F.greatest(F.col("i"), j)))
    into = F.when(F.col("core"), F.transform(upto("rests"), lambda j: name("core", j, F.col("i")))).otherwise(F.concat(with_core, with_rest))
    return m.select(F.explode(into).alias("region"), "digest", "rep", "n", "core")


def region_components(docs: DataFrame, members: DataFrame) -> DataFrame:
    """node, root of the classes that link with another, from neighbourhoods (region, digest, rep, n)."""
    members = members.withColumn("core", F.lit(False))
    sized = members.join(members.groupBy("region").agg(F.sum("n").alias("size")), "region")
    small = written(leaf_links(docs, sized.where(F.col("size") <= BLOCK)), "join-small").toDF("node", "root")
    large, links, depth = written(sized.where(F.col("size") > BLOCK).drop("core"), "join-large"), [], 0
    if large.isEmpty():
        return small
    while not large.isEmpty():
        found, new = cut_by_pivots(docs, large, depth)
        links.append(found)
        sums = new.groupBy("region").agg(F.sum("n").alias("size"), F.count_if(~F.col("core")).alias("rest"))
        new = new.join(sums, "region").where("rest > 0")
        shrunk = (F.col("size") <= SHRINKS * F.col("before")) & F.lit(depth < DEEPEST)
        links.append(written(leaf_links(docs, new.where(F.col("size") <= BLOCK)), "join-leaves"))
        links.append(written(leaf_links(docs, block_members(new.where((F.col("size") > BLOCK) & ~shrunk))), "join-blocks"))
        large = written(new.where((F.col("size") > BLOCK) & shrunk).select("region", "digest", "rep", "n", "size"), "join-large")
        depth += 1
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    return small.unionByName(components(every, name="join-links"))


def jaccard_groups(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id for each row of docs (doc_id, text).

    Null and empty texts, and texts of white space, have no shingles, link with nothing and are their own component.
    Texts with equal sets are one class (by a 128-bit digest of the set), whose copies are never compared. Repeated rows
    stay and share a component; null ids give way to other ids of the component. Very long texts are read whole. An empty
    table gives an empty result; other columns are not carried."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    hot = spark.sparkContext.broadcast(hot_shingles(docs))
    rows = written(sketched(docs, hot), "join-sketches")
    full = rows.where("n > 0")
    classes = written(full.groupBy("digest").agg(F.first("cid").alias("cid"), F.first("n").alias("n"), F.first("sketch", ignorenulls=True).alias("sketch"), F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "join-classes")
    members = neighbourhoods(rows, classes)
    stars = region_components(docs, members)
    grouped_ = classes.join(stars, classes["digest"] == stars["node"], "left").select("digest", "rep", "copies", F.coalesce("root", "digest").alias("root"), F.col("root").isNotNull().alias("linked"))
    least = grouped_.where("linked").groupBy("root").agg(F.min("rep").alias("least"))
    other = grouped_.where("linked or copies > 1").join(least, "root", "left").select(F.col("digest").alias("of"), F.coalesce("least", "rep").alias("component_id"))
    other = written(other, "join-groups")
    forget(classes, members)
    out = rows.select("doc_id", "text_key", "n", "digest").join(other, F.col("digest") == F.col("of"), "left")
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: of each group the document with the least id stays, once; documents without shingles stay.

    Rows with equal id and text are one document, of which one row stays; a group whose ids are all null keeps one row of
    each text. Only rows that a filter of those that go, and of those that occur twice, lets through are dealt out and
    looked up; all others stay where they are. Nulls, empty texts and empty tables pass."""
    found = jaccard_groups(docs).where("n_shingles > 0")
    keys = found.groupBy("doc_id", "text_key").agg(F.count("*").alias("times"), F.first("component_id").alias("component_id"))
    gone = ~F.col("doc_id").eqNullSafe(F.col("component_id"))
    i, k, g, h, m = unused(docs, "gone_id", "gone_key", "gone", "own_key", "maybe")
    marked = written(keys.where(gone | (F.col("times") > 1)).select(F.col("doc_id").alias(i), F.col("text_key").alias(k), gone.alias(g)), "join-gone")
    name = lambda a, b: F.xxhash64(a, b)
    among = filter_of(marked.select(name(i, k)))
    each = docs.withColumn(h, F.xxhash64("text"))
    each = each.withColumn(m, among(name("doc_id", h)))
    both = each.where(m).join(marked, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(h) == F.col(k)), "left")
    kept = each.where(~F.col(m)).select(*docs.columns).unionByName(both.where(F.col(g).isNull()).select(*docs.columns))
    if not marked.where(~F.col(g)).isEmpty():
        kept = kept.unionByName(both.where(~F.col(g)).dropDuplicates(["doc_id", h]).select(*docs.columns))
    return kept


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT r, unnest(CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS s FROM w),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
e AS (SELECT a.r AS a, b.r AS b FROM g a JOIN g b ON a.s = b.s AND a.r < b.r JOIN n x ON x.r = a.r JOIN n y ON y.r = b.r GROUP BY a.r, b.r, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
ab AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(a, b) AS (SELECT a, b FROM ab UNION SELECT reach.a, ab.b FROM reach JOIN ab ON reach.b = ab.a),
low AS (SELECT a AS r, min(doc_id) AS component_id FROM (SELECT a, b FROM reach UNION SELECT r, r FROM w) JOIN w ON w.r = b GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM w LEFT JOIN n USING (r) JOIN low USING (r)
"""
