"""Benchmark decontamination: a BM25 inverted index of the test items, searched with block-max WAND.

An item's score for a passage is the BM25 weight of the item's words that the passage holds, divided by
that of all its words, so 1 means every word is there. Items lie in blocks (sorted by their rarest words,
so that alike items share a block), and each term has its largest weight in each block. A training text
is cut into overlapping passages twice as long as the longest item of a length class (lengths between two
powers of two), so every run of words of an item's length lies whole in one, and a long item costs only its
own class. Passages whose rare terms can't make up for what common terms lack are passed over. For the others
the block maxima of their words bound every item's score in a block; only blocks whose bound reaches the
threshold are opened, of their words' postings only those of the block are read, and there the WAND pivot
rule skips items whose own terms' maxima can't reach it. Everything above the threshold is retrieved,
whatever its rank, and then verified: the share of the item's five-word shingles that the passage holds, for
its question (all but the last sentence) and its answer (the last sentence) each.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaica.llm.common import col, per_text, ready, stored

K1, B = 1.2, 0.75
#: Share of an item's BM25 weight that a retrieved passage holds, and of its shingles that a verified one holds.
THRESHOLD, OVERLAP = 0.7, 0.8
SHINGLE = 5
#: Items of a block, and the most items and bytes of text that one index holds; what is more is searched in further passes.
BLOCK, MOST_ITEMS, MOST_BYTES = 8, 20_000, 8_000_000
#: Words of a text taken at a time.
STEP = 1 << 16

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_CLEAR = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Runs of letters and digits (any byte of a non-ASCII character counts as a letter), A-Z lowered."""
    return text.translate(_CLEAR).split()


def question_and_answer(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """The words before the answer, and the answer: the last sentence, with words before it up to SHINGLE words if it is shorter."""
    parts = [w for s in re.split(rb"(?<=[.!?])\s+", text.strip()) if (w := words(s))]
    w = [x for p in parts for x in p]
    n = max(SHINGLE, len(parts[-1])) if len(parts) > 1 else 0
    return (w[:-n], w[-n:]) if 0 < n < len(w) else (w, [])


def shingles(codes: np.ndarray, n: int, none: int) -> np.ndarray:
    """Hashes of the runs of n codes that hold no `none`; n is at most SHINGLE."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    c = codes.astype(np.uint64) + np.uint64(1)
    h = sum(c[i : m + i] * _ODD[i] for i in range(n))
    h = (h ^ (h >> np.uint64(29))) * _ODD[1]
    known = np.concatenate([[0], np.cumsum(codes == none)])
    return (h ^ (h >> np.uint64(32)))[known[n:] == known[:m]]


def spread(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    n = ends - starts
    return np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)


class LengthClass:
    """Postings of items of about one length: for each term its blocks with the largest weight in each, and for each of these the items."""

    def __init__(self, ids: list[int], codes: list[np.ndarray], parts: list[list[np.ndarray]], idf: np.ndarray, df: np.ndarray, mean: float, threshold: float, block: int):
        rarest = [min((int(df[t]), int(t)) for t in c) for c in codes]
        order = sorted(range(len(ids)), key=lambda i: (rarest[i], ids[i] is not None, ids[i] or 0))  # a null id comes first
        self.ids = [ids[i] for i in order]
        self.parts = [parts[i] for i in order]
        codes = [codes[i] for i in order]
        self.longest = max(map(len, codes))
        terms, items, weights = [], [], []
        for at, c in enumerate(codes):
            t, tf = np.unique(c, return_counts=True)
            w = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(c) / mean))
            terms.append(t)
            items.append(np.full(len(t), at, np.int32))
            weights.append(w / w.sum())
        sizes = [len(t) for t in terms]
        term, item, weight = map(np.concatenate, (terms, items, weights))
        # rare terms: without enough of their weight no item reaches the threshold, whatever common terms a passage holds
        cuts = np.unique(df[term])
        owner = np.repeat(np.arange(len(codes)), sizes)
        common = lambda cut: np.bincount(owner, weight * (df[term] > cut), len(codes)).max()
        lo, hi = 0, len(cuts) - 1
        while lo < hi:  # the smallest cut above which terms weigh half of the threshold at most
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if common(cuts[mid]) <= threshold / 2 else (mid + 1, hi)
        self.needed = threshold - common(cuts[lo]) - 1e-3
        by = np.lexsort((item, term))
        term, self.item, self.weight = term[by], item[by], weight[by]
        key = term.astype(np.int64) << 32 | self.item // block
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        self.entry = np.append(first, len(key))  # where the postings of each (term, block) start
        self.block = (key[first] & 0xFFFFFFFF).astype(np.int32)
        self.top = np.maximum.reduceat(self.weight, first) * 1.00001
        self.term = np.searchsorted(key[first] >> 32, np.arange(len(df) + 1))  # where the entries of each term start
        self.blocks = -(-len(ids) // block)
        best = np.zeros(len(df) + 1)
        np.maximum.at(best, term, self.weight * 1.00001)
        self.rare = np.where(np.append(df, 1 << 40) <= cuts[lo], best, 0.0)

    def retrieve(self, terms: np.ndarray, threshold: float) -> Iterator[int]:
        """Items whose score for a passage with these terms reaches the threshold."""
        entries = spread(self.term[terms], self.term[terms + 1])
        at = self.block[entries]
        bound = np.bincount(at, self.top[entries], self.blocks)
        for block in np.flatnonzero(bound >= threshold - 1e-4):
            yield from self.search_block(entries[at == block], threshold - 1e-9)

    def search_block(self, entries: np.ndarray, theta: float) -> list[int]:
        """Items of one block (the entries of a passage's terms there) whose score reaches theta, by the WAND pivot rule."""
        lists = [[self.item[s:e].tolist(), 0, self.weight[s:e].tolist(), m] for s, e, m in zip(self.entry[entries], self.entry[entries + 1], self.top[entries].tolist(), strict=True)]
        found = []
        while lists:
            lists.sort(key=lambda x: x[0][x[1]])
            bound, pivot = 0.0, None
            for x in lists:
                bound += x[3]
                if bound >= theta:
                    pivot = x[0][x[1]]
                    break
            if pivot is None:
                break
            if lists[0][0][lists[0][1]] == pivot:
                if sum(x[2][x[1]] for x in lists if x[0][x[1]] == pivot) >= theta:
                    found.append(pivot)
                pivot += 1
            for x in lists:
                while x[1] < len(x[0]) and x[0][x[1]] < pivot:
                    x[1] += 1
            lists = [x for x in lists if x[1] < len(x[0])]
        return found


class Index:
    """BM25 over items (id, text); items without words are left out."""

    def __init__(self, items: list[tuple[int, bytes]], threshold: float = THRESHOLD, overlap: float = OVERLAP, block: int = BLOCK):
        self.threshold, self.overlap = threshold, overlap
        docs = [(i, w, t) for i, t in items if (w := words(t))]
        df = Counter(t for _, w, _ in docs for t in set(w))
        self.number = {t: k for k, t in enumerate(sorted(df))}
        count = np.array([df[t] for t in self.number], np.int64)
        idf = np.log1p((len(docs) - count + 0.5) / (count + 0.5))
        mean = sum(len(w) for _, w, _ in docs) / max(1, len(docs))
        none, by = len(self.number), {}
        for i, w, t in docs:
            parts = [self.codes(p) for p in question_and_answer(t) if p]
            held = by.setdefault(len(w).bit_length(), ([], [], []))
            held[0].append(i)
            held[1].append(self.codes(w))
            held[2].append([(n := min(SHINGLE, len(c)), np.unique(shingles(c, n, none))) for c in parts])
        self.classes = [LengthClass(*by[k], idf, count, mean, threshold, block) for k in sorted(by)]

    def codes(self, w: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.number.get, w, repeat(len(self.number))), np.int32, len(w))

    def search(self, text: bytes) -> list[tuple[int, float, float, float]]:
        """(item, question overlap, answer overlap, whole overlap) of each item found in the whole text, best passage first kept."""
        w, none = words(text), len(self.number)
        codes, out = self.codes(w), []
        for part in self.classes:
            best: dict[int, tuple[float, float, float]] = {}
            span, long = 2 * part.longest, max(STEP, 2 * part.longest)
            for at in range(0, max(len(w), 1), long):
                c = codes[at : at + long + span]
                # a passage is `span` words, and starts every span / 2; only those with enough rare terms are looked at
                starts = np.arange(0, max(1, len(c) - part.longest + 1), part.longest)
                ends = np.minimum(starts + span, len(c))
                sums = np.concatenate([[0.0], np.cumsum(part.rare[c])])
                for p in np.flatnonzero(sums[ends] - sums[starts] >= part.needed):
                    here, held = c[starts[p] : ends[p]], {}
                    terms = np.unique(here)
                    for item in part.retrieve(terms[terms != none], self.threshold):
                        sizes, share = [], []
                        for n, s in part.parts[item]:
                            if n not in held:
                                held[n] = np.unique(shingles(here, n, none))
                            sizes.append(len(s))
                            share.append(np.isin(s, held[n], assume_unique=True).sum() / len(s))
                        if min(share) >= self.overlap:
                            new = (float(share[0]), float(share[-1]), float(np.dot(share, sizes) / sum(sizes)))
                            best[item] = max(best.get(item, new), new, key=lambda z: z[2])
            out += [(part.ids[i], *v) for i, v in sorted(best.items())]
        return out


_FOUND = "array<struct<item_id: long, question_overlap: double, answer_overlap: double, overlap: double>>"
_FOUND_ARROW = pa.list_(pa.struct([("item_id", pa.int64())] + [(n, pa.float64()) for n in ("question_overlap", "answer_overlap", "overlap")]))


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """(doc_id, item_id, question_overlap, answer_overlap, overlap): a row for each row of docs and item found in it.

    Each index holds about MOST_ITEMS items and MOST_BYTES of their text at most (a broadcast of some ten MB); more give
    further passes over docs, one index at a time; none is left out. Items without words match nothing; null and empty texts hold
    nothing; copies of an item are all reported, as are repeated rows of docs. An empty table on either side gives no rows.
    """
    docs, out = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text")), None
    names = ("item_id", "question_overlap", "answer_overlap", "overlap")
    for index, alone in _indexes(docs, items, item_id, item_text, threshold, overlap):

        def make(index=index):
            return lambda t: [dict(zip(names, m, strict=True)) for m in index.value.search(t)]

        found = docs.select("doc_id", F.explode(per_text(make, _FOUND, _FOUND_ARROW)("text")).alias("m")).select("doc_id", *[F.col(f"m.{n}").alias(n) for n in names])
        if not alone:
            found = stored(found)
            index.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """docs (every column) without the rows that hold an item, by the rule of matches(). No row is shuffled.

    Rows with a null or empty text stay, repeated rows stay or go together, and an empty table of items takes nothing away.
    """
    for index, alone in _indexes(docs, items, item_id, item_text, threshold, overlap):

        def make(index=index):
            return lambda t: bool(index.value.search(t))

        docs = docs.where(~per_text(make, "boolean", pa.bool_())(col(text)))
        if not alone:
            docs = stored(docs)
            index.destroy()
    return docs


def _indexes(docs: DataFrame, items: DataFrame, item_id: str, item_text: str, threshold: float, overlap: float) -> Iterator[tuple]:
    """Broadcast indexes of all items, one after the other, and whether there is but one."""
    spark = ready(docs.sparkSession)
    items = items.where(col(item_text).isNotNull()).select(col(item_id).cast("long").alias("i"), col(item_text).cast("binary").alias("t"))
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    passes = max(1, -(-n // MOST_ITEMS), -(-size // MOST_BYTES))
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == k).collect()  # bounded by MOST_ITEMS and MOST_BYTES
        yield spark.sparkContext.broadcast(Index([(r["i"], bytes(r["t"])) for r in part], threshold, overlap)), passes == 1
