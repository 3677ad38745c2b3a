"""Embedding near-dedup with an inverted multi-index.

Vectors are scaled to length 1 and cut into halves; each half has a codebook of its own, and the two
nearest codewords name a vector's cell in the product grid. A query goes through cells by the multi-sequence
rule, a heap of the next cell of each row of the grid, in the order of how far its halves are from each cell's border (squared distances to
the borders of the two halves' regions, added), and stops at the first cell past a radius. The radius is set so that the wanted
share of neighbours exactly at the threshold is reached, measured on simulated neighbours of a bounded
sample; neighbours above it are nearer and are reached more often. Everything visited is verified by its
cosine in double precision. Vectors are scaled by their largest component first, so that tiny and huge ones keep their direction.
"""

from __future__ import annotations

import heapq
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from mosaica.llm.common import BLOCK, col, components, forest, grouped, ready, skew_join, stored

#: Rows the codebooks and the radius are fitted on (an expected number: rows are drawn by a hash).
SAMPLE = 20_000
#: Share of neighbours at the threshold that the traversal is to reach from one side.
RECALL = 0.999
#: Vectors of a label that a cell should hold on average, and the largest codebook (the sample has ten vectors for each of its words).
#: Cells keep that size up to PER_CELL * MOST_WORDS ** 2 (268 million) vectors of a label; beyond, they grow.
PER_CELL, MOST_WORDS = 64, 2048


def parts(x: np.ndarray, rows: int = 1024) -> list[np.ndarray]:
    """x in parts of so many rows."""
    return [x[at : at + rows] for at in range(0, len(x), rows)]


def codebook(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's k-means of the rows of x, started from k of them; the rows of a half without components are all alike."""
    if not x.shape[1]:
        return np.zeros((1, 0))
    rng = np.random.default_rng(7)
    words = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = np.concatenate([((words**2).sum(1) - 2 * part @ words.T).argmin(1) for part in parts(x)])
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, x[:, d], k) for d in range(x.shape[1])], 1)
        words[n > 0] = sums[n > 0] / n[n > 0, None]
    return words


class MultiIndex:
    """Codebooks for the two halves, and the radius at which a traversal ends."""

    def __init__(self, halves: tuple[np.ndarray, np.ndarray], radius: float = math.inf):
        self.words, self.radius = halves, radius
        squares = [(w**2).sum(1) for w in halves]
        self.gaps = [np.sqrt(np.maximum(s[:, None] + s - 2 * w @ w.T, 1e-18)) for s, w in zip(squares, halves, strict=True)]

    def __reduce__(self):
        return MultiIndex, (self.words, self.radius)

    def split(self, x: np.ndarray) -> list[np.ndarray]:
        cut = len(self.words[0][0])
        return [x[:, :cut], x[:, cut:]]

    def borders(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The cell of each row, and for each half the squared distance to the border of each codeword's region (0: its own)."""
        cells, far = [], []
        for half, words, gap in zip(self.split(x), self.words, self.gaps, strict=True):
            d = (words**2).sum(1) - 2 * half @ words.T
            own = d.argmin(1)
            to = (d - d[np.arange(len(d)), own][:, None]) / (2 * gap[own])
            to[np.arange(len(d)), own] = 0
            cells.append(own)
            far.append(to**2)
        return cells, far

    def visits(self, far: list[np.ndarray], q: int) -> list[int]:
        """Cells (i * words + j) of query q in multi-sequence order, nearest first; the first one past the radius ends the traversal."""
        near = [np.flatnonzero(f[q] <= self.radius) for f in far]
        a, b = (n[np.argsort(f[q][n], kind="stable")] for n, f in zip(near, far, strict=True))
        u, v = far[0][q][a].tolist(), far[1][q][b].tolist()
        a, b, words, out = a.tolist(), b.tolist(), far[1].shape[1], []
        taken, heap = [0] * (len(a) + 1), [(u[0] + v[0], 0, 0)]
        while heap:
            far_off, i, j = heapq.heappop(heap)
            if far_off > self.radius:
                break
            out.append(a[i] * words + b[j])
            taken[i] = j + 1
            if i + 1 < len(a) and taken[i + 1] == j:  # the cells before it in its row are done
                heapq.heappush(heap, (u[i + 1] + v[j], i + 1, j))
            if j + 1 < len(b) and (i == 0 or taken[i - 1] > j + 1):
                heapq.heappush(heap, (u[i] + v[j + 1], i, j + 1))
        return out

    def tune(self, x: np.ndarray, cosine: float, recall: float) -> None:
        """Set the radius from neighbours of x at exactly this cosine, in random directions."""
        rng, reached = np.random.default_rng(11), []
        for part in parts(x):
            y = rng.standard_normal(part.shape)
            y -= (y * part).sum(1, keepdims=True) * part
            y = cosine * part + math.sqrt(max(0.0, 1 - cosine**2)) * y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
            _, far = self.borders(part)
            (i, j), _ = self.borders(y)
            at = np.arange(len(part))
            reached.append(far[0][at, i] + far[1][at, j])
        self.radius = float(np.quantile(np.concatenate(reached), recall)) + 1e-9


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows (finite, not zero) at length 1; the largest component is made 1 first, so that no square is lost or too large."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _number(kind: DataType) -> str:
    """float where the components are: they travel as they are, and are compared as doubles."""
    return "float" if kind.simpleString() == "float" else "double"


def usable(vector: F.Column) -> F.Column:
    """Whether a vector can link: not null, no null or non-finite component, not all zero."""
    ok = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)))
    return F.coalesce(vector.isNotNull() & ok & F.exists(vector, lambda v: v != 0), F.lit(False))


def fit(reps: DataFrame, rows: int, labels: int, cosine: float, recall: float = RECALL, sample: int = SAMPLE) -> MultiIndex | None:
    """The index of vectors, all of one width, fitted on about `sample` of them; None if none were drawn."""
    share = min(1.0, sample / max(rows, 1))
    drawn = reps.where(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("v").toPandas()["v"]
    if not len(drawn):
        return None
    x = _unit(np.stack(list(drawn)).astype(float)).astype(np.float32)
    width = x.shape[1]
    k = int(min(MOST_WORDS, max(2, math.isqrt(max(1, rows // max(labels, 1) // PER_CELL)))))
    cut = width // 2
    index = MultiIndex((codebook(x[:, :cut], k), codebook(x[:, cut:], k)))
    index.tune(x, cosine, recall)
    return index


def near_duplicates(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.98, recall: float = RECALL, block: int = BLOCK
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each row.

    Two rows link if their labels are equal and not null and the cosine of their vectors, in double
    precision, is at least `cosine`. Null, zero and non-finite vectors link with nothing. Vectors of
    different lengths don't link. Copies (equal vectors of a label) are one class: its members link with each other and with all
    members of linked classes, without a row for each pair. A null vec_id never names a component. Rows
    with equal ids each keep their row. An empty table gives no rows.
    """
    ready(rows.sparkSession)
    kind = _number(rows.schema[vector].dataType.elementType)
    rows = rows.select(col(vec_id).alias("vec_id"), col(label).alias("label"), col(vector).cast(f"array<{kind}>").alias("v"))
    ok = F.col("label").isNotNull() & usable(F.col("v"))
    keyed = rows.select("vec_id", "label", "v", F.when(ok, F.xxhash64("label", F.transform("v", lambda x: x.cast("double") + F.lit(0.0)))).alias("node"))
    keyed = stored(keyed)
    classes = keyed.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"), F.xxhash64(F.first("label"), F.size(F.first("v"))).alias("group"), F.first("v").alias("v"))
    classes = stored(classes)
    # widths between two powers of two share an index; shorter vectors get zeros, which change no cosine, and their width stays part of the label
    power = F.ceil(F.log2(F.size("v")))
    sizes = classes.groupBy(power.alias("power")).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("group").alias("l"), F.max(F.size("v")).alias("width")).orderBy("power").collect()
    parts_ = []
    for size in sizes:
        if size["n"] > 1:  # the only class of its widths has no others to link with
            zeros = F.array_repeat(F.lit(0).cast(kind), F.lit(size["width"]) - F.size("v"))
            same = classes.where(power == size["power"]).select("node", "group", "n", F.concat("v", zeros).alias("v"))
            index = fit(same, size["n"], size["l"], cosine, recall)
            if index is None:  # none of few were drawn
                index = fit(same, size["n"], size["l"], cosine, recall, size["n"])
            parts_.append(stored(_verified(same, index, cosine, block)))
    if not sizes:
        return keyed.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = reduce(DataFrame.unionByName, parts_, classes.sparkSession.createDataFrame([], "a long, b long, n long"))
    degree = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("near"))
    comp = components(found.where("b is not null").select("a", "b"))
    tied = skew_join(classes.select("node", "n", "first"), comp, ["node"], "left").withColumn("component", F.coalesce("component", "node"))
    tied = stored(skew_join(tied, degree, ["node"], "left"))
    first = tied.groupBy("component").agg(F.min("first").alias("component_id"))
    of_node = skew_join(tied, first, ["component"]).select("node", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("links"), "component_id")
    linked = skew_join(keyed.where("node is not null").select("vec_id", "node"), of_node, ["node"])
    alone = keyed.where("node is null").select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component_id"))
    both = linked.select("vec_id", "links", "component_id").unionByName(alone)
    return both.select("vec_id", F.col("links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _verified(classes: DataFrame, index: MultiIndex, cosine: float, block: int) -> DataFrame:
    """(a, null, n): a links with n rows of other classes, summed over rows; (a, b, 0): a spanning forest of the links."""
    width = sum(len(w[0]) for w in index.words)
    words = len(index.words[0])

    def deal(batches):
        for batch in batches:
            node, group, n, v = (batch.column(i) for i in range(4))
            if not batch.num_rows:
                continue
            x = _unit(v.values.to_numpy().reshape(-1, width).astype(float))
            cells, far = index.borders(x)
            own = cells[0] * words + cells[1]
            seen = [index.visits(far, q) for q in range(len(x))]
            at = np.repeat(np.arange(len(x)), [len(s) for s in seen])
            cell = np.concatenate([np.array(s, np.int64) for s in seen])
            yield pa.RecordBatch.from_arrays(
                [group.take(pa.array(at)), pa.array(cell), pa.array(own[at] == cell), node.take(pa.array(at)), n.take(pa.array(at)), v.take(pa.array(at))],
                names=["group", "cell", "home", "node", "n", "v"],
            )

    dealt = classes.select("node", "group", "n", "v").mapInArrow(deal, f"group long, cell long, home boolean, node long, n long, v {classes.schema['v'].dataType.simpleString()}")
    dealt = stored(dealt.withColumn("key", F.xxhash64("group", "cell")))
    # a cell's members are compared with its visitors, in parts of at most about `block` rows each
    counts = dealt.groupBy("key").agg(F.count_if("home").alias("_h"), F.count(F.lit(1)).alias("_q")).where("_h > 0 and _q > 1")
    parts = {c: F.ceil(F.col(c) / block) for c in ("_h", "_q")}
    part = {c: F.pmod(F.xxhash64("node"), parts[c]) for c in parts}
    upto = lambda c: F.sequence(F.lit(0).cast("long"), parts[c] - 1)
    met = skew_join(dealt, counts, ["key"])
    as_query = met.select("key", F.explode(upto("_h")).alias("hp"), part["_q"].alias("qp"), F.lit(False).alias("member"), "node", "n", "v")
    as_member = met.where("home").select("key", part["_h"].alias("hp"), F.explode(upto("_q")).alias("qp"), F.lit(True).alias("member"), "node", "n", "v")
    parts_n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = as_query.unionByName(as_member).repartition(parts_n, "key", "hp", "qp").sortWithinPartitions("key", "hp", "qp")

    def verify(batches):
        for _, _, _, member, node, n, v in grouped(batches, 3):
            member = member.astype(bool)
            if not member.any() or member.all():
                continue
            x = _unit(np.stack(v).astype(float))
            m, q = np.flatnonzero(member), np.flatnonzero(~member)
            i, j = np.nonzero(x[q] @ x[m].T >= cosine - 1e-9)
            i, j = q[i], m[j]
            ok = (node[i] != node[j]) & ((x[i] * x[j]).sum(1) >= cosine)
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            # the pair also comes up in the query's own cell if the member visits that; then the smaller node's query counts it
            cells, far = index.borders(x)
            back = far[0][j, cells[0][i]] + far[1][j, cells[1][i]] <= index.radius
            ok = ~back | (node[i] < node[j])
            i, j = i[ok], j[ok]
            near = np.bincount(i, n[j], len(x)) + np.bincount(j, n[i], len(x))
            at = np.flatnonzero(near)
            label = forest(len(x), i, j)
            tied = np.flatnonzero((label != np.arange(len(x))) & (node[label] != node))
            a = np.concatenate([node[at], node[tied]])
            b = pa.array(np.concatenate([np.zeros(len(at), np.int64), node[label[tied]]]), mask=np.arange(len(a)) < len(at))
            yield pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(np.concatenate([near[at], np.zeros(len(tied))]).astype(np.int64))], names=["a", "b", "n"])

    return met.mapInArrow(verify, "a long, b long, n long")
