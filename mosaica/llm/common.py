"""Helpers that the training-data operators share.

Everything here is a composition of DataFrame operations; the numpy parts run inside tasks on
blocks whose size is fixed by a parameter, never by the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaica.sources.scratch import shared_dir, stored  # noqa: F401

#: Rows of one Arrow batch between the JVM and Python. Texts can be long, so batches are short.
ARROW_ROWS = 512
#: Members of a block that one task compares with another block of this size.
BLOCK = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> SparkSession:
    """The session with Arrow batches of at most ARROW_ROWS rows and a checkpoint folder."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    shared_dir(spark)
    return spark


def free(df: DataFrame, name: str) -> str:
    """name, or that with underscores before it, so that no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def col(name: str) -> Column:
    """The column of this very name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def skew_join(rows: DataFrame, groups: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """rows joined with groups, which has one row for each key.

    Both sides are dealt by an exchange of this join alone (a column made from the keys keeps Spark from
    reusing the partitioning of the aggregate that made `groups`; it is short, as it travels with every row),
    so adaptive execution can split the partition of a hot key and copy the one matching row.
    """
    mark, name = F.xxhash64(*on).bitwiseAND(F.lit(127)).cast("tinyint"), free(rows, "_mark")
    return rows.withColumn(name, mark).join(groups.withColumn(name, mark), [name, *on], how).drop(name)


class Memo(dict):
    """make(key) for each key, remembered if the key is not longer than `longest`; when `most` keys are held, it starts again.

    So it holds a fixed number of bytes at most. memo.__getitem__ is quick to map.
    """

    def __init__(self, make: Callable, most: int, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


def per_text(make: Callable[[], Callable[[bytes], object]], kind: str, arrow: pa.DataType) -> Callable[[Column], Column]:
    """A column function of texts (null: empty bytes). make() gives, once for each task, what maps the bytes of a text to a value.

    Only the texts go to Python and only the values come back; the other columns of the rows wait in the JVM. It counts as not
    deterministic so that a filter on it does not run it a second time.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fn = make()
        for texts in batches:
            yield pa.array([fn(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts], arrow)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind).asNondeterministic()


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | dict], schema: str) -> DataFrame:
    """df through fn, one Arrow batch at a time; fn may return a dict of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                yield pa.RecordBatch.from_pydict(out) if isinstance(out, dict) else out

    return df.mapInArrow(run, schema)


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list]:
    """Runs of equal keys (the first `keys` columns, integers) of sorted batches, as lists of numpy columns.

    Runs of one row are passed over. A run is held whole, so its length must be bounded (see block_pairs).
    """
    held: list[list[np.ndarray]] = []

    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [c.to_numpy(zero_copy_only=False) for c in batch.columns]

    def cut(cols: list[np.ndarray], last: bool) -> tuple[list[list[np.ndarray]], list[np.ndarray]]:
        n = len(cols[0])
        new = np.zeros(n, bool)
        new[:1] = True
        for c in cols[:keys]:
            new[1:] |= c[1:] != c[:-1]
        at = np.append(np.flatnonzero(new), n)
        stop = len(at) - 1 if last else len(at) - 2
        runs = [[c[at[i] : at[i + 1]] for c in cols] for i in np.flatnonzero(np.diff(at)[:stop] > 1)]
        return runs, [c[at[stop] :] for c in cols]

    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(columns(batch))
            size += batch.num_rows
            if size < 4096:
                continue
            runs, rest = cut([np.concatenate(c) for c in zip(*held, strict=True)], False)
            yield from runs
            held, size = [rest], 0
    if held:
        yield from cut([np.concatenate(c) for c in zip(*held, strict=True)], True)[0]


def block_pairs(rows: DataFrame, key: str, member: str, block: int = BLOCK) -> DataFrame:
    """rows (integers `key` and `member`, and more), so that each pair of members of a key meets in one group (key, lo, hi).

    Keys with one member are left out. A key with more than `block` members is dealt into parts by a
    hash; each pair of parts is a group, so no task holds more than about two blocks of a key. Adds
    `lo`, `hi` and `part` and sorts within partitions by key, lo, hi.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    parts = F.ceil(F.col("_n") / block)
    part = F.pmod(F.xxhash64(member), parts)
    dealt = (
        skew_join(rows, counts, [key])
        .withColumn("part", part)
        .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
        .withColumn("lo", F.least("part", "_other"))
        .withColumn("hi", F.greatest("part", "_other"))
        .drop("_n", "_other")
    )
    rest = [c for c in dealt.columns if c not in (key, "lo", "hi")]
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.select(key, "lo", "hi", *rest).repartition(n, key, "lo", "hi").sortWithinPartitions(key, "lo", "hi")


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n members the smallest member that the links (i, j) lead to."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (a long, b long): component is the smallest node reachable.

    Alternates the large-star and small-star steps of the map-reduce connected components algorithm:
    each pass is two aggregates and two joins whose hot keys can be split, and passes grow with the
    logarithm of the longest chain. Each pass is checkpointed; only a count and a hash reach the driver.
    """
    ready(links.sparkSession)
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = edges.checkpoint()
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = skew_join(both, low, ["a"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = skew_join(large, low, ["a"])
        small = (
            moved.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
            .select("x.a", "x.b")
            .where("a <> b")
            .distinct()
        )
        edges = small.checkpoint()
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
