"""Periodic runs of words by block convolution.

A run is a stretch of words with smallest period q that is at least three periods and LEAST words long and can't be extended.
At scale b (a power of two) the periods from b to 2b - 1 are looked for: a run of three such periods holds a block of b words
at a multiple of b that comes again, word for word, q places later. The block is compared with all its places in the windows
that follow by one convolution: the sum of squared differences of residues that stand for the words, which is the sum of both sides' squares
less twice their correlation, and is zero where no word differs. Correlations are taken by a number-theoretic transform, so they are exact
integers modulo a prime; each zero is checked word for word. Blocks longer than MOST_BLOCK are cut to that length, their windows come in pieces.

Each distance found seeds an extension to both sides, the maximal stretch that repeats at that distance. A block that comes
three times or more within its own length is itself periodic, with a period that a smaller scale has seen, and then only distances at which
ends of its stretch and of the stretch it meets lie over each other can give a run with a longer period. So past the first scale
no block gives more than two seeds a window.
Many texts are worked on as one array, with a different residue between each two, which no run can cross.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaica.llm.common import col, ready

#: Words of the shortest run, and periods that it holds at least.
LEAST, PERIODS = 24, 3
#: Words of the smallest and of the longest block that is transformed.
FIRST_BLOCK, MOST_BLOCK = 8, 128
#: Words of texts that are worked on as one array, and values that one transform takes.
TOGETHER, AT_ONCE = 1 << 17, 1 << 18
#: Bytes of a text that are split into words at a time.
STEP = 1 << 20
#: 7 * 2 ** 20 + 1; 3 generates its units. Products of two residues around zero and sums of twice MOST_BLOCK of them are exact doubles.
PRIME, ROOT = 7340033, 3

_space = re.compile(rb"[\x09-\x0d ]")


def _mod(x: np.ndarray) -> np.ndarray:
    """Residues around zero."""
    return x - PRIME * np.rint(x / PRIME)


@cache
def _powers(n: int, inverse: bool) -> np.ndarray:
    """Entry (i, j): the power i * j of a root of unity of order n."""
    w = pow(ROOT, (PRIME - 1) // n * (n - 1 if inverse else 1), PRIME)
    row = np.array([pow(w, i, PRIME) for i in range(n)], np.int64)
    return _mod(row[np.arange(n)[:, None] * np.arange(n) % n].astype(float))


@cache
def _twiddles(n: int, p: int, q: int, inverse: bool) -> np.ndarray:
    w = pow(ROOT, (PRIME - 1) // n * (n - 1 if inverse else 1), PRIME)
    return _mod(np.array([[pow(w, i * j, PRIME) for j in range(q)] for i in range(p)], float))


def transform(x: np.ndarray, inverse: bool = False) -> np.ndarray:
    """The number-theoretic transform of each row (a power of two of residues); the inverse isn't divided by the length."""
    rows, n = x.shape
    if n <= 32:
        return _mod(x @ _powers(n, inverse))
    p = 1 << (n.bit_length() - 1) // 2
    q = n // p
    # places p' * q + q': over p', then turned, then over q'
    y = _mod(x.reshape(rows, p, q).transpose(0, 2, 1).reshape(-1, p) @ _powers(p, inverse)).reshape(rows, q, p)
    y = _mod(y * _twiddles(n, p, q, inverse).T)
    y = _mod(y.transpose(0, 2, 1).reshape(-1, q) @ _powers(q, inverse)).reshape(rows, p, q)
    return y.transpose(0, 2, 1).reshape(rows, n)


def _sums(x: np.ndarray, n: int) -> np.ndarray:
    """The sum of each n whole numbers in a row."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(x.astype(np.int64))])
    return (total[n:] - total[:-n]).astype(float)


def no_mismatch(r: np.ndarray, at: int, rows: int, step: int, block: int, first: int) -> np.ndarray:
    """For blocks of residues r at `at`, at + step, ... whether the sum of squared differences to the places first .. first + block - 1 later is zero modulo the prime."""
    n, stop = 2 * block, at + (rows - 1) * step
    wide = r[at : stop + first + n]
    wide = np.concatenate([wide, np.zeros(stop + first + n - at - len(wide))])
    each = lambda x, start, size: np.lib.stride_tricks.sliding_window_view(x[start : start + stop - at + size], size)[::step]
    u = np.zeros((rows, n))
    u[:, :block] = each(wide, 0, block)
    back = np.concatenate([[0], np.arange(n - 1, 0, -1)])  # the transform of a reversed row
    product = _mod(transform(u)[:, back] * transform(each(wide, first, n)))
    both = _mod(transform(product, True)[:, :block] * _mod(np.array(pow(n, -1, PRIME), float)))
    squares = _sums(wide * wide, block)
    return _mod(each(squares, 0, 1) + each(squares, first, block) - 2 * both) == 0


class _Seeds:
    """Extensions of one array of words at one scale; an extension is remembered by its distance until the next one."""

    def __init__(self, words: np.ndarray):
        self.w, self.last = words, {}

    def extend(self, at: int, stop: int, d: int) -> tuple[int, int, bool] | None:
        """(start, end, new): the longest stretch around at .. stop whose words all come again d places later; None if those in it don't."""
        lo, hi = self.last.get(d, (0, -1))
        if lo <= at and stop <= hi:
            return lo, hi, False
        w, n = self.w, len(self.w)
        if stop + d > n or not np.array_equal(w[at:stop], w[at + d : stop + d]):
            return None
        lo, hi, step = at, stop, 64
        while hi + d < n:
            k = min(step, n - d - hi)
            bad = w[hi : hi + k] != w[hi + d : hi + d + k]
            if bad.any():
                hi += int(bad.argmax())
                break
            hi, step = hi + k, 2 * step
        step = 64
        while lo:
            k = min(step, lo)
            bad = (w[lo - k : lo] != w[lo - k + d : lo + d])[::-1]
            if bad.any():
                lo -= int(bad.argmax())
                break
            lo, step = lo - k, 2 * step
        self.last[d] = lo, hi
        return lo, hi, True


@cache
def _factors(n: int) -> tuple[int, ...]:
    """The prime factors of n."""
    out, f = [], 2
    while f * f <= n:
        if n % f == 0:
            out.append(f)
            while n % f == 0:
                n //= f
        f += 1
    return (*out, *([n] if n > 1 else []))


def _found(words: np.ndarray, residues: np.ndarray, b: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of runs with periods of scale b; FIRST_BLOCK takes all that are smaller too."""
    low, high, block = (1 if b == FIRST_BLOCK else b), 2 * b, min(b, MOST_BLOCK)
    seeds, rows = _Seeds(words), max(1, AT_ONCE // (2 * block))
    for first in range(low, high, block):
        starts = np.arange(0, len(words) - first - block + 1, b)
        for k in range(0, len(starts), rows):
            part = starts[k : k + rows]
            zero = no_mismatch(residues, int(part[0]), len(part), b, block, first)
            zero[:, high - first :] = False
            which, far = np.nonzero(zero)
            if not len(which):
                continue
            at = np.flatnonzero(np.diff(which, prepend=-1))
            for i, lo, hi in zip(part[which[at]].tolist(), at.tolist(), [*at[1:].tolist(), len(which)], strict=True):
                d = (far[lo:hi] + first).tolist()
                if len(d) > 2 and b > FIRST_BLOCK:
                    p = d[1] - d[0]
                    own, other = seeds.extend(i, i + block - p, p), seeds.extend(i + d[0], i + d[0] + block - p, p)
                    if own and other:  # else a zero was one of the prime only
                        ends = {other[0] - own[0], other[1] - own[1]} - {0}
                        d = [x for x in d if x in ends] if own[:2] != other[:2] else []
                for x in d:
                    got = seeds.extend(i, i + block, x)
                    if got is None or not got[2]:
                        continue
                    start, length = got[0], got[1] - got[0] + x
                    if length >= max(LEAST, PERIODS * x):
                        held = words[start : start + length]
                        if not any(np.array_equal(held[x // f :], held[: length - x // f]) for f in _factors(x)):
                            yield start, length, x


def runs_of(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each text, in order; texts are arrays of numbers, equal ones for equal words, and below 2 ** 62."""
    out: list[set] = [set() for _ in texts]
    size = np.array([len(t) for t in texts], np.int64)
    b = FIRST_BLOCK
    while True:
        some = np.flatnonzero(size >= max(LEAST, PERIODS * (b if b > FIRST_BLOCK else 1)))
        if not len(some):
            break
        # a number that no word has after each text
        words = np.concatenate([x for i, s in enumerate(some.tolist()) for x in (texts[s], [-1 - i])])
        ends = np.cumsum(size[some] + 1)
        h = words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        residues = ((h ^ h >> np.uint64(29)) & np.uint64(0xFFFF)).astype(float) - 0x8000
        for start, length, period in _found(words, residues, b):
            i = int(np.searchsorted(ends, start, "right"))
            out[some[i]].add((int(start - (ends[i] - size[some[i]] - 1)), length, period))
        b *= 2
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the most periods; of equal ones that with the smallest start, then the smallest period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay if of each run only its first period does."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


class _Numbers(dict):
    """A number for each word; a new one gets the next."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _numbered(text: bytes, ids: _Numbers) -> np.ndarray:
    """The number of each word of a text."""
    out, at = [], 0
    while at < len(text):
        stop = min(len(text), at + STEP)
        if stop < len(text):  # up to white space
            stop = found.start() if (found := _space.search(text, stop)) else len(text)
        words = text[at:stop].split()
        out.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
        at = stop
    return np.concatenate(out) if out else np.zeros(0, np.int64)


DIGESTS = {"n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(), "exponent_milli": pa.int64(), "runs_sha256": pa.string(), "collapsed_sha256": pa.string()}


def _summary(words: np.ndarray, names: list[bytes], runs: list[tuple[int, int, int]]) -> dict:
    best = strongest(runs)
    start, length, period = best or (None, None, None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    keep, digest = words[kept_words(len(words), runs)] if runs else words, hashlib.sha256()
    for at in range(0, len(keep), STEP):
        digest.update(b" " * (at > 0) + b" ".join(map(names.__getitem__, keep[at : at + STEP].tolist())))
    return {"n_runs": len(runs), "start": start, "length": length, "period": period, "exponent_milli": 1000 * length // period if best else None, "runs_sha256": hashlib.sha256(listed).hexdigest(), "collapsed_sha256": digest.hexdigest()}


def _over_texts(finish: Callable[[np.ndarray, list[bytes], list[tuple[int, int, int]]], object], kind: str, arrow: pa.DataType, texts: Column, change: Column, changed: Callable[[np.ndarray, int], np.ndarray]) -> Column:
    """finish(words, names, runs) of each text, after changed(words, change) where `change` isn't null. Texts are taken together up to TOGETHER words."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for column, how in batches:
            out, held, ids = [], [], _Numbers()

            def flush(out=out, held=held, ids=ids):
                names = list(ids)
                out.extend(finish(w, names, r) for w, r in zip(held, runs_of(held), strict=True))
                held.clear()
                ids.clear()

            size = 0
            for t, k in zip(column, how.to_pylist(), strict=True):
                words = _numbered(t.as_buffer().to_pybytes() if t.is_valid else b"", ids)
                held.append(words if k is None or not len(words) else changed(words, k))
                size += len(words)
                if size >= TOGETHER:
                    flush()
                    size = 0
            flush()
            yield pa.array(out, arrow)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind).asNondeterministic()(texts, change)


def _same(words: np.ndarray, _: int) -> np.ndarray:
    return words


def _binary(docs: DataFrame, text: str) -> Column:
    return F.coalesce(col(text).cast("string"), F.lit("")).cast("binary")


RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def with_runs(docs: DataFrame, text: str = "text", name: str = "runs") -> DataFrame:
    """docs with `name`: the runs of each text as (start, length, period) in words, by start, then period; [] where there are none, or for a null text."""
    ready(docs.sparkSession)
    make = lambda words, names, runs: [{"start": s, "length": n, "period": q} for s, n, q in runs]
    return docs.withColumn(name, _over_texts(make, "array<struct<start: long, length: long, period: long>>", RUN, _binary(docs, text), F.lit(None).cast("long"), _same))


def collapsed(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs whose texts with runs keep only the first period of each, their words joined by one space; other texts, null ones too, stay as they are."""
    ready(docs.sparkSession)

    def make(words, names, runs):
        return b" ".join(map(names.__getitem__, words[kept_words(len(words), runs)].tolist())).decode("utf-8", "surrogatepass") if runs else None

    return docs.withColumn(text, F.coalesce(_over_texts(make, "string", pa.string(), _binary(docs, text), F.lit(None).cast("long"), _same), col(text)))


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", change: Column | None = None, changed: Callable[[np.ndarray, int], np.ndarray] = _same) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256): a row for each row of docs.

    start to exponent_milli are of the run with most periods, null without runs. The first digest is of all runs, a line start,length,period for each,
    the second of the words that collapsed() keeps, joined by one space. `changed` makes other words of a text's words first, where the number `change` isn't null. A
    null text counts as empty; repeated rows and null ids each keep their row; an empty table gives no rows.
    """
    ready(docs.sparkSession)
    kind = "struct<" + ", ".join(f"{n}: {'string' if t == pa.string() else 'long'}" for n, t in DIGESTS.items()) + ">"
    made = _over_texts(_summary, kind, pa.struct(list(DIGESTS.items())), _binary(docs, text), (F.lit(None) if change is None else change).cast("long"), changed)
    return docs.select(col(doc_id).alias("doc_id"), made.alias("d")).select("doc_id", "d.*")
