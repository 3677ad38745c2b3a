"""SimHash near-dedup over pivot distance tables.

The reference fingerprints (pivots) are the 64 words of a Hadamard code. A row's table holds its Hamming
distance to each. By the triangle inequality two fingerprints within `radius` differ in no coordinate by
more than `radius`, so pairs are discarded by their largest coordinate difference.

Pairs that differ too much in the first coordinates are never made: each of these coordinates is cut in two
where it splits the table best, and the sides of all cuts name a row's cell. A row whose coordinate lies
within the radius of a cut stands on both sides, so each pair within the radius meets in a cell. As many
coordinates are cut as bring a cell to about CELL rows; the codewords are as different as can be, so cuts
halve cells independently of each other. Within a cell, pairs are discarded coordinate by coordinate over
the whole table, and survivors are verified by their Hamming distance. Nothing within the radius is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaica.llm.common import block_pairs, components, forest, grouped, map_batches, per_text, ready, skew_join, stored

RADIUS = 2
#: Rows that a cell should hold; a cut whose larger side keeps more than WORST of the rows is not made. A further cut makes 1.2 rows of one and leaves
#: 0.6 of a cell, so it pays while comparing a row with half its cell costs more than dealing it out, which is about a thousand comparisons in numpy.
#: Copies grow as the power 0.39 of the distinct fingerprints (2.0 at 10,000, 15 at a million, 213 at a billion), comparisons for each copy stay alike.
CELL, WORST = 2048, 0.9
SHINGLE = 3
SEED = 42
#: Shingles hashed at a time, so that a very long text needs little memory.
STEP = 1 << 16


def pivots() -> np.ndarray:
    """The reference fingerprints: bit b of the k-th is the parity of the ones that k and b share."""
    k = np.arange(64, dtype=np.uint64)
    bits = np.bitwise_count(k[:, None] & k) & 1
    return np.packbits(bits.astype(np.uint8), axis=1).view(">u8").ravel().astype(np.uint64)


def distances(x: np.ndarray) -> np.ndarray:
    """The table of fingerprints: a row for each, a column for each pivot."""
    return np.bitwise_count(x[:, None] ^ pivots()).astype(np.int8)


def fingerprint(text: bytes | None) -> int:
    """The 64-bit SimHash of a text: a bit is set if it is set in over half of the shingles' hashes; 0 without words."""
    words = (text or b"").lower().split()  # bytes: lower() is A-Z only, split() is on \x20 and \x09-\x0D only
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    ones, n = np.zeros(64, np.int64), len(words) - SHINGLE + 1
    for at in range(0, n, STEP):
        part = words[at : min(n, at + STEP) + SHINGLE - 1]
        h = np.fromiter(
            (xxhash.xxh64_intdigest(b" ".join(z), SEED) for z in zip(part, part[1:], part[2:], strict=False)),
            ">u8",
            len(part) - SHINGLE + 1,
        )
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `fp` (long: the fingerprint's 64 bits) instead of the text. Null texts count as empty."""
    ready(docs.sparkSession)

    def make():
        return lambda t: int(np.uint64(fingerprint(t)).view(np.int64))

    return docs.withColumn("fp", per_text(make, "long", pa.int64())(F.col(text))).drop(text)


def cuts(counts: np.ndarray, radius: int, cell: int = CELL) -> list[tuple[int, int]]:
    """(pivot, cut) of the coordinates to cut, best first, from how many rows have each distance (a row of counts for each pivot).

    A row at distance d stands on the lower side if d <= cut and on the upper one if d > cut - radius.
    """
    n = counts[0].sum()
    below = np.cumsum(counts, 1)
    above = n - np.concatenate([np.zeros((len(counts), radius), below.dtype), below[:, :-radius]], 1) if radius else n - below
    share = np.maximum(below, above) / max(n, 1)
    at = share.argmin(1)
    out, rows = [], float(n)
    for p in np.argsort(share.min(1), kind="stable"):
        if rows <= cell or share[p, at[p]] > WORST:
            break
        out.append((int(p), int(at[p])))
        rows *= share[p, at[p]]
    return out


def links(fps: DataFrame, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """(a, b): a spanning forest, cell by cell, of all pairs of distinct fingerprints within the radius."""
    fps = stored(fps.select("fp").distinct())

    def count(batches):
        total = np.zeros((64, 65), np.int64)
        for batch in batches:
            d = distances(batch.column(0).to_numpy().view(np.uint64))
            for p in range(64):
                total[p] += np.bincount(d[:, p], minlength=65)
        pivot, far = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pivot), pa.array(far), pa.array(total[pivot, far])], names=["pivot", "far", "n"])

    counts = np.zeros((64, 65), np.int64)
    for r in fps.mapInArrow(count, "pivot long, far long, n long").groupBy("pivot", "far").agg(F.sum("n").alias("n")).collect():  # at most 64 x 65 rows
        counts[r["pivot"], r["far"]] = r["n"]
    chosen = cuts(counts, radius, cell)

    def deal(batch: pa.RecordBatch) -> dict:
        x = batch.column(0).to_numpy()
        d = distances(x.view(np.uint64))
        row, key = np.arange(len(x)), np.ones(len(x), np.int64)
        for pivot, cut in chosen:
            low, high = np.flatnonzero(d[row, pivot] <= cut), np.flatnonzero(d[row, pivot] > cut - radius)
            row, key = np.concatenate([row[low], row[high]]), np.concatenate([2 * key[low], 2 * key[high] + 1])
        return {"key": pa.array(key), "fp": pa.array(x[row])}

    dealt = block_pairs(map_batches(fps, deal, "key long, fp long"), "key", "fp")

    def run(batches):
        for _, lo, hi, fp, part in grouped(batches, 3):
            x = fp.view(np.uint64)
            d = distances(x)
            left = np.flatnonzero(part == lo[0])
            right = np.flatnonzero(part == hi[0])
            near = np.abs(d[left, 0][:, None] - d[right, 0]) <= radius
            if lo[0] == hi[0]:
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            i, j = left[i], right[j]
            for c in range(1, d.shape[1]):
                ok = np.abs(d[i, c] - d[j, c]) <= radius
                i, j = i[ok], j[ok]
            ok = np.bitwise_count(x[i] ^ x[j]) <= radius
            label = forest(len(x), i[ok], j[ok])
            tied = np.flatnonzero(label != np.arange(len(x)))
            if len(tied):
                yield pa.RecordBatch.from_arrays([pa.array(fp[tied]), pa.array(fp[label[tied]])], names=["a", "b"])

    return dealt.select("key", "lo", "hi", "fp", "part").mapInArrow(run, "a long, b long")


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): one row for each row of docs.

    component_id is the smallest doc_id whose fingerprint can be reached by links of at most `radius`
    differing bits. Null, empty and blank texts have fingerprint 0, which links like any other. Repeated
    rows and repeated ids each keep their row; a null doc_id keeps its row and never names a component
    (null if no other row is there). Other columns of docs don't matter. An empty table gives no rows.
    """
    rows = stored(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))))
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    comp = components(links(rows, radius)).withColumnRenamed("node", "fp")
    tied = stored(skew_join(classes, comp, ["fp"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component")))
    first = tied.groupBy("component").agg(F.min("first").alias("component_id"))
    of_fp = skew_join(tied.select("fp", "component"), first, ["component"]).select("fp", "component_id")
    return skew_join(rows, of_fp, ["fp"]).select("doc_id", "fp", "component_id")
