"""How filters that are applied one after the other interact, for every order of them.

A document is a mask of the filters that it fails, so all that matters about a corpus is how many documents (and how
many good and toxic ones) of each part have each mask: a table of at most 2 ** k rows a part. For k filters the masks
are a matrix with 0 where a filter is failed and infinity where it is passed, and the orders are a matrix of inverse
permutations, the step at which each order applies each filter. Their min-plus product is the step at which each order
removes each mask. Counts of masks are then scattered, as weights, to the steps that remove them; a step's redundancy is
what fails its filter but was removed before.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaica.llm.common import col, free, map_batches, per_text, ready, skew_join, stored

#: Filters that can be audited together; there are 720 orders of six.
MOST = 6
#: Words of a short text; distinct words and capitals in a hundred; bytes that mark markup.
SHORT, DISTINCT, CAPITALS, MARKS = 200, 50, 2, b"#$%&*|"

_UPPER = bytes(range(65, 91))
_CONTINUED = bytes(range(128, 192))
FAILURES = {"part": "string", "filter_order": "string", "step": "int"}
COUNTS = ["kept", "removed", "redundant", "unique_fails"]


def text_failures(text: bytes) -> int:
    """Bits 0 to 3: too few words, too few different words, too many capitals, marks."""
    words = text.split()
    points = len(text) - (len(text) - len(text.translate(None, _CONTINUED)))
    capitals = len(text) - len(text.translate(None, _UPPER))
    marks = len(text) != len(text.translate(None, MARKS))
    return (len(words) < SHORT) | (100 * len(set(words)) < DISTINCT * len(words)) << 1 | (100 * capitals > CAPITALS * points) << 2 | marks << 3


def failures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", name: str = "mask") -> DataFrame:
    """docs (every column but the text) with the mask of the five filters A to E, A being bit 0; E: an other row with a smaller id has this text.

    A null text is an empty one. A null id is smaller than none and none is smaller than it; rows of one id are no copies of each other.
    Texts are equal if their 64-bit hash, their CRC and their length are. Texts are read once and never shuffled; a text
    that many documents share meets its smallest id in a join whose hot keys can be split. A column called `name` is replaced.
    """
    ready(docs.sparkSession)
    docs = docs.drop(name) if name not in (doc_id, text) else docs
    own = {n: free(docs, f"_{n}") for n in ("mask", "hash", "crc", "bytes", "first", "last")}
    kept = [col(c) for c in docs.columns if c != text]
    mask = per_text(lambda: text_failures, "tinyint", pa.int8())
    whole = F.coalesce(col(text), F.lit("")).cast("binary")
    rows = stored(docs.select(*kept, mask(whole).alias(own["mask"]), F.xxhash64(whole).alias(own["hash"]), F.crc32(whole).alias(own["crc"]), F.octet_length(whole).alias(own["bytes"])))
    key = [own["hash"], own["crc"], own["bytes"]]
    ident = col(doc_id)
    firsts = rows.groupBy(*key).agg(F.min(ident).alias(own["first"]), F.max(ident).alias(own["last"])).where(F.col(own["first"]) < F.col(own["last"])).select(*key, own["first"])
    both = skew_join(rows, firsts, key, "left")
    copy = F.coalesce(ident > F.col(own["first"]), F.lit(False)).cast("int")
    return both.select(*kept, (F.col(own["mask"]).cast("int") + F.shiftleft(copy, 4)).alias(name))


def removal_steps(k: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """The orders of k filters, lexicographic, and for each mask (rows) and order (columns) the step, from 0, that removes it; k: none does."""
    orders = list(permutations(range(k)))
    place = np.argsort(np.array(orders, int).reshape(len(orders), k), axis=1)  # inverse permutations: the step of each filter
    fails = np.arange(1 << k)[:, None] >> np.arange(k) & 1
    cost = np.where(fails == 1, 0.0, np.inf)
    steps = (cost[:, None, :] + place[None, :, :]).min(2, initial=float(k))  # min-plus
    return orders, steps.astype(np.int64)


def interactions(rows: DataFrame, part: Column, names: str, mask: str = "mask", lost: dict[str, Column] | None = None) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, one more count for each of `lost`, shapley.

    rows have a mask of failed filters; names has a letter for each bit. A row for each part, each order of the filters and each step from 1, zeros
    included. `lost` names conditions whose rows are counted where a step removes them (null: not counted). redundant: rows that fail the step's filter but
    were removed before; unique_fails: that fail it alone; shapley: what its filter removes, summed over all orders. A null part is
    an empty string. Only counts of masks are shuffled, at most 2 ** k for a part and task. No rows give no rows.
    """
    k, lost = len(names), lost or {}
    if not 0 < k <= MOST or len(set(names)) != k:
        raise ValueError(f"between 1 and {MOST} filters with different letters can be audited, not {names!r}")
    orders, steps = removal_steps(k)
    extra = list(lost)
    at = {f: n for n, f in enumerate(["_n", *extra])}
    counted = rows.groupBy(F.coalesce(part.cast("string"), F.lit("")).alias("part"), col(mask).cast("int").alias("_mask"))
    counted = counted.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in lost.items()])
    # a list of at most 2 ** k masks for each part
    by_part = counted.groupBy("part").agg(F.collect_list(F.struct("_mask", *at)).alias("_w"))
    masks, order = np.arange(1 << k), np.array(orders, int)
    filters = order.ravel()  # of each order and step
    here = (masks[:, None] >> order.reshape(1, -1) & 1).reshape(len(masks), len(orders), k) == 1
    before = here & (steps[:, :, None] < np.arange(k))
    scatter = np.arange(len(orders)) * (k + 1) + steps  # where each mask goes in each order; step k keeps it
    text = ["".join(names[f] for f in o) for o in orders]

    def audit(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {}
        for name, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            w = np.zeros((len(at), len(masks)), np.int64)
            for f, n in at.items():
                w[n, cell.values.field("_mask").to_numpy()] = cell.values.field(f).to_numpy()
            gone = np.zeros((len(at), len(orders) * (k + 1)), np.int64)
            for n in range(len(at)):
                np.add.at(gone[n], scatter, w[n][:, None])
            gone = gone.reshape(len(at), len(orders), k + 1)[:, :, :k]
            of_filter = np.zeros(k, np.int64)
            np.add.at(of_filter, filters, gone[0].ravel())
            got = {
                "part": [name] * filters.size, "filter_order": np.repeat(text, k), "step": np.tile(np.arange(1, k + 1), len(orders)), "kept": w[0].sum() - gone[0].cumsum(1), "removed": gone[0],
                "redundant": np.tensordot(w[0], before, 1), "unique_fails": w[0][1 << filters], **{n: gone[at[n]] for n in extra}, "shapley": of_filter[filters],
            }
            for n, v in got.items():
                out.setdefault(n, []).extend(np.asarray(v).ravel().tolist())
        return {n: pa.array(v, pa.string() if n in ("part", "filter_order") else pa.int32() if n == "step" else pa.int64()) for n, v in out.items()}

    return map_batches(by_part, audit, ", ".join([*(f"{n} {t}" for n, t in FAILURES.items()), *(f"`{n}` long" for n in [*COUNTS, *lost, "shapley"])]))


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """interactions() of the five filters ABCDE over docs by `part`, with good_lost and toxic_lost.

    labels: doc_id, quality, toxic. A document is good (toxic) if any row of its id says quality = 1 (toxic = 1); ids that are null match none.
    Repeated rows of docs count each; an empty table gives no rows.
    """
    masks = failures(docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"), col(part).alias("part")))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = skew_join(masks, known, ["doc_id"], "left")
    return interactions(rows, F.col("part"), "ABCDE", lost={"good_lost": F.col("good"), "toxic_lost": F.col("toxic")})
