"""Claims from dependency parses. The parser is external: its trees come as a column of (idx, head, rel, text, tag), its events as the idx of their roots."""

from __future__ import annotations

import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags that no phrase is made of; relations by which a phrase grows, and on which side; relations of arguments, of
# clauses, and of what a clause contributes; weights.
NO_PHRASE = frozenset(("PRON", "DET", "VERB", "NUM"))
GROWS = (("name", "after"), ("goeswith", "after"), ("mwe", "before"), ("compound", "nearest first"), ("amod", "nearest first"))
BELOW_MARKER = frozenset(("appos", "nmod"))
ARGUMENTS = frozenset(("nsubj", "nsubjpass", "dobj", "iobj", "nmod", "dep"))
CLAUSES = frozenset(("csubj", "csubjpass", "ccomp", "xcomp", "advcl"))
TOKENS = re.compile("MAINCIT|CIT|FORMULA|REF|TABLE|FIGURE")
HALVING, FALLBACK = 0.5, 0.25


class Tree:
    """A sentence's nodes by idx, and the dependents of each in order. A head that is no node (0) marks the root."""

    def __init__(self, nodes):
        self.node = {n["idx"]: n for n in nodes}
        self.below = defaultdict(list)
        for n in nodes:
            self.below[n["head"]].append(n)

    def phrases(self, n) -> list[str]:
        """The longest phrases that a node heads: with its names and fixed expressions, then with its compounds and adjectives from the
        nearest to the farthest, each conjunct of one in its place, adverbs before their adjective. Placeholder tokens are taken out."""
        usable = lambda rel, of: [d for d in self.below[of["idx"]] if d["rel"] == rel and d["tag"] not in NO_PHRASE]
        grown = [n["text"] if n["tag"] not in NO_PHRASE else ""]
        for rel, side in GROWS:
            found = usable(rel, n)
            for d in reversed(found) if side == "nearest first" else found:
                bare = grown[-1]
                grown.append(f"{bare} {d['text']}" if side == "after" else f"{d['text']} {bare}")
                if side != "nearest first":
                    continue
                for other in usable("conj", d):
                    bare = grown[-2]
                    grown.append(f"{other['text']} {bare}")
                if rel == "amod":
                    for adverb in (x for x in self.below[d["idx"]]):
                        if adverb["rel"] == "advmod" and adverb["tag"] not in NO_PHRASE:
                            grown.append(f"{adverb['text']} {grown[-1]}")
                        for other in usable("conj", adverb):
                            grown.append(f"{other['text']} {grown[-2]}")
        clean = [" ".join(TOKENS.sub("", x).split()) for x in grown]
        return [x for x in clean if x and not any(len(x) < len(y) and x in y for y in clean)]

    def inside(self, root):
        """The root and all nodes below it but punctuation."""
        left = [root]
        while left:
            n = left.pop()
            yield n
            left += [d for d in self.below[n["idx"]] if d["rel"] != "punct"]

    def marker(self, root):
        return next((n for n in self.inside(root) if n["text"] == "MAINCIT"), None)

    def predicate(self, root) -> str:
        """The root's word, or its copula."""
        return next((d["text"] for d in self.below[root["idx"]] if d["rel"] == "cop"), root["text"])

    def top(self, n):
        while n["head"] in self.node:
            n = self.node[n["head"]]
        return n

    def noun_phrases(self, root) -> set[str]:
        return {p for n in self.inside(root) if n["tag"] == "NOUN" for p in self.phrases(n)}

    def toward_predicate(self, root) -> tuple[int, set[str]] | None:
        """Steps from the marker up to an event's root, and the phrases met: right below the marker, on the way, and as the root's other
        arguments, those of a clause being the clause's own. None without a marker."""
        at = self.marker(root)
        if at is None:
            return None
        met = [d for d in self.below[at["idx"]] if d["rel"] in BELOW_MARKER]
        depth, passed = 0, None
        while at["idx"] != root["idx"]:
            met.append(at)
            depth, passed, at = depth + 1, at["idx"], self.node[at["head"]]
        for d in self.below[root["idx"]]:
            if d["idx"] == passed:
                continue
            if d["rel"] in ARGUMENTS:
                met.append(d)
            elif d["rel"] in CLAUSES:
                met += [x for x in self.below[d["idx"]] if x["rel"] in ARGUMENTS | {"conj"}]
        return depth, {p for n in met for p in self.phrases(n)}


def normal_terms(predicate: str, phrases) -> list[str]:
    """predicate:phrase in lower case, all but letters and digits to single spaces; in order."""
    return sorted(f"{predicate.lower()}:{' '.join(re.sub('[^A-Za-z0-9]', ' ', p).lower().split())}" for p in phrases)


def claims_by_marker(nodes, events) -> list[tuple[float, str]]:
    """predicate:phrase terms of the events that hold the marker. The event that it is nearest to has weight 1, each further one half of
    the weight before. Without any, the first event's sentence's noun phrases, with weight 0.25."""
    tree, out, weight = Tree(nodes), [], 1.0
    roots = [tree.node[e] for e in events if e in tree.node]
    ways = [(way, r) for r in roots if (way := tree.toward_predicate(r)) and way[1]]
    for (_, phrases), r in sorted(ways, key=lambda x: x[0][0]):
        out += [(weight, x) for x in normal_terms(tree.predicate(r), phrases)]
        weight *= HALVING
    if not out and roots:
        out = [(FALLBACK, x) for x in normal_terms(tree.predicate(roots[0]), tree.noun_phrases(tree.top(roots[0])))]
    return out


def claims_by_nouns(nodes, events, whole: bool = False) -> list[tuple[float, str]]:
    """predicate:phrase terms of each event's noun phrases, or of its whole sentence's."""
    tree = Tree(nodes)
    roots = [tree.node[e] for e in events if e in tree.node]
    return [(1.0, x) for r in roots for x in normal_terms(tree.predicate(r), tree.noun_phrases(tree.top(r) if whole else r))]


def claim_terms(tree: Column, events: Column, by: str = "marker") -> Column:
    """Weighted claim terms of a parse: by "marker", by "nouns" of the events, or by nouns of the whole "sentence". A null tree has none."""
    makers = {"marker": claims_by_marker, "nouns": claims_by_nouns, "sentence": lambda t, e: claims_by_nouns(t, e, True)}
    make = makers[by]

    @F.pandas_udf("array<struct<weight: double, term: string>>")
    def found(trees: pd.Series, roots: pd.Series) -> pd.Series:
        return pd.Series([[] if t is None else [{"weight": w, "term": x} for w, x in make(t, [] if e is None else e)] for t, e in zip(trees, roots)])

    return found(tree, events)


def exemplified(tree: Column) -> Column:
    """Pairs (example, of) of node idx: nominal modifiers with "such as", and what they are examples for. From a case word "such" that "as" is a fixed expression with."""
    such = lambda n: F.exists(tree, lambda s: (s["head"] == n["idx"]) & (s["rel"] == "case") & (s["text"] == "such") & F.exists(tree, lambda a: (a["head"] == s["idx"]) & (a["rel"] == "mwe") & (a["text"] == "as")))
    return F.transform(F.filter(tree, lambda n: (n["rel"] == "nmod") & such(n)), lambda n: F.struct(n["idx"].alias("example"), n["head"].alias("of")))
