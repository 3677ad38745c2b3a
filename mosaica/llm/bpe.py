"""Byte-level BPE by dynamic programming over byte prefixes.

BPE gives every byte string exactly one token sequence, and each prefix of the string has its own. Of
these sequences it is enough to keep the last token: the sequence of prefix i is that of prefix
i - len(last[i]), followed by last[i]. Token t ends prefix i iff t is a suffix of it and BPE leaves the
pair (last token of the prefix before t, t) as it is. Exactly one token does. So

* appending bytes extends the table and touches nothing before it (exact appends), and
* after an edit only the table from the edit to where two tables agree again has to be filled.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaica.llm.common import Memo, free, per_text, ready

#: Pieces and pairs that a worker remembers; when full, it starts again. A matter of speed alone: some 40 MB each at most.
MEMO = 200_000
#: Pieces up to SHORT bytes share one store of prefixes, so a word is only worked on from where it leaves all words before.
SHORT, PREFIXES = 48, 300_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PrefixTable:
    """The last token of each prefix of one piece; grows by append(), and edit() refills what an edit can change."""

    def __init__(self, bpe: "PrefixBPE", piece: bytes = b""):
        self.bpe, self.data, self.last = bpe, bytearray(), []
        self.append(piece)

    def append(self, more: bytes) -> "PrefixTable":
        self.data += more
        self._fill(len(self.last), len(self.data))
        return self

    def _fill(self, start: int, stop: int) -> None:
        data, last, longest = bytes(self.data), self.last, self.bpe.longest
        ids, pairs = self.bpe.ids.get, self.bpe._pairs
        for i in range(start + 1, stop + 1):
            for k in range(max(0, i - longest), i):
                t = ids(data[k:i])
                if t is not None and (k == 0 or pairs[last[k - 1], t]):
                    last.append(t)
                    break
            else:
                raise ValueError("the vocabulary lacks a single byte")

    def edit(self, at: int, gone: int, new: bytes) -> "PrefixTable":
        """Replace data[at:at+gone] by new. Old entries are reused once as many in a row as the longest token agree."""
        old, keep = self.last[at + gone :], self.bpe.longest
        self.data[at : at + gone] = new
        del self.last[at:]
        self._fill(at, at + len(new))
        same = 0
        for j, was in enumerate(old):
            self._fill(len(self.last), len(self.last) + 1)
            # a reused entry looks back at most `longest` entries; all of these must be the old ones
            same = same + 1 if self.last[-1] == was else 0
            if same > keep:
                self.last += old[j + 1 :]
                break
        return self

    def tokens(self) -> list[int]:
        out, i = [], len(self.last)
        while i:
            out.append(self.last[i - 1])
            i -= len(self.bpe.bytes_of[out[-1]])
        return out[::-1]


class PrefixBPE:
    def __init__(self, ranks: dict[bytes, int]):
        self.ids = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self._pairs = Memo(self._fits, MEMO)  # keys are pairs of ids
        self._parts: dict[int, tuple[int, int] | None] = {}
        self.last: dict[bytes, int] = {}

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one when BPE runs on its bytes; None for a byte."""
        if token not in self._parts:
            piece = self.bytes_of[token]
            p = [piece[i : i + 1] for i in range(len(piece))]
            while len(p) > 2:
                ranks = [self.ids.get(a + b, 1 << 40) for a, b in zip(p, p[1:], strict=False)]
                i = ranks.index(min(ranks))
                p[i : i + 2] = [p[i] + p[i + 1]]
            self._parts[token] = (self.ids[p[0]], self.ids[p[1]]) if len(p) == 2 else None
        return self._parts[token]

    def edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """Tokens that stand at an edge (0: left, 1: right) while this one is built, and the merge that ends each."""
        out, until = [], 1 << 40
        while token is not None:
            out.append((self.bytes_of[token], until))
            until, token = token, (self.parts(token) or (None, None))[side]
        return out

    def _fits(self, pair: tuple[int, int]) -> bool:
        """BPE keeps the border between two tokens iff no token at its left edge merges with one at its right before
        both are used up; of merges with one rank the left goes first."""
        a, b = pair
        right = self.edge(b, 0)
        for x, until_x in self.edge(a, 1):
            for y, until_y in right:
                m = self.ids.get(x + y)
                if m is not None and m < until_x and m <= until_y:
                    return False
        return True

    def fits(self, a: int, b: int) -> bool:
        """Whether BPE leaves token a (-1: nothing) followed by token b as these two tokens."""
        return a < 0 or self._pairs[a, b]

    def encode(self, piece: bytes) -> list[int]:
        """The tokens of one piece."""
        t = self.ids.get(piece)
        if t is not None:
            return [t]
        if len(piece) > SHORT:
            return PrefixTable(self, piece).tokens()
        if len(self.last) > PREFIXES:
            self.last.clear()
        last, ids, pairs = self.last, self.ids.get, self._pairs
        n = known = len(piece)
        while known and piece[:known] not in last:
            known -= 1
        for i in range(known + 1, n + 1):
            for k in range(i):
                t = ids(piece[k:i])
                if t is not None and (k == 0 or pairs[last[piece[:k]], t]):
                    last[piece[:i]] = t
                    break
        out = []
        while n:
            t = last[piece[:n]]
            out.append(t)
            n -= len(self.bytes_of[t])
        return out[::-1]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Tokenizer:
    """Texts to ids and back: each match of the pattern is a piece of its own; no special tokens."""

    def __init__(self, path: str, pattern: str):
        self.bpe, self.pattern = PrefixBPE(load_ranks(path)), regex.compile(pattern)
        self.memo = Memo(lambda p: tuple(self.bpe.encode(p.encode("utf-8", "surrogatepass"))), MEMO)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.memo.__getitem__, self.pattern.findall(text))))

    def decode(self, ids) -> bytes:
        return self.bpe.decode(ids)


@lru_cache(1)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    """One for each worker process."""
    return Tokenizer(path, pattern)


def _columns(path: str, pattern: str, kind: str, arrow: pa.DataType, value):
    """A column function of texts: value(tokenizer, text) of each."""

    def make():
        t = tokenizer(path, pattern)
        return lambda b: value(t, b.decode("utf-8", "surrogatepass"))

    return per_text(make, kind, arrow)


def _ids(t: Tokenizer, text: str) -> np.ndarray:
    return np.array(t.encode(text), np.int32)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs (every column) with `ids` array<int>, the tokens of the whole text. Null texts count as empty: no ids.

    `path` must name a file that every executor can open, such as one installed with a package. A column
    `ids` that docs already has is replaced, unless it is the text. Each row, repeated ones too, is encoded by itself;
    an empty table gives no rows.
    """
    ready(docs.sparkSession)
    return docs.withColumn("ids", _columns(path, pattern, "array<int>", pa.list_(pa.int32()), _ids)(F.col(text)))


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """rows (every column) with `decoded` binary, the bytes of their ids; null ids give null, empty ones no bytes. A column `decoded` is replaced.

    Repeated rows are decoded alike; an empty table gives no rows.
    """
    ready(rows.sparkSession)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = tokenizer(path, pattern)
        for batch in batches:
            yield pa.array([None if not x.is_valid else t.decode(x.values.to_numpy().tolist()) for x in batch], pa.binary())

    return rows.withColumn("decoded", F.arrow_udf(run, "binary")(F.col(ids)))


def tokenized(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs (every column) with `ids` as encode() gives them and `exact`: whether they decode to the bytes of the text. One pass for both."""
    ready(docs.sparkSession)

    def value(t: Tokenizer, s: str) -> dict:
        ids = t.encode(s)
        return {"ids": np.array(ids, np.int32), "exact": t.decode(ids) == s.encode("utf-8", "surrogatepass")}

    both, own = pa.struct([("ids", pa.list_(pa.int32())), ("exact", pa.bool_())]), free(docs, "_both")
    rows = docs.withColumn(own, _columns(path, pattern, "struct<ids: array<int>, exact: boolean>", both, value)(F.col(text)))
    return rows.withColumns({"ids": F.col(own)["ids"], "exact": F.col(own)["exact"]}).drop(own)


def digests(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row, repeated ones too: encode, hash, decode and hash in one pass,
    so that no ids travel between the JVM and Python. Same tokens as encode() and decode(). Null texts count as empty;
    an empty table gives no rows."""
    ready(docs.sparkSession)

    def value(t: Tokenizer, s: str) -> dict:
        ids = t.encode(s)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return {"n": len(ids), "ids": sha(" ".join(map(str, ids)).encode()), "text": sha(t.decode(ids))}

    kind = pa.struct([("n", pa.int64()), ("ids", pa.string()), ("text", pa.string())])
    rows = docs.select(F.col(doc_id).alias("doc_id"), _columns(path, pattern, "struct<n: long, ids: string, text: string>", kind, value)(F.col(text)).alias("d"))
    return rows.select("doc_id", F.col("d.n").alias("n_tokens"), F.col("d.ids").alias("ids_sha256"), F.col("d.text").alias("decoded_sha256"))
