"""Pairing two domains of a case by slide coordinates, or by id where the coordinates can't be read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_cases(meta: DataFrame) -> DataFrame:
    """(domain, case_id) whose every row has whole-number x and y."""
    ok = F.expr("try_cast(x AS INT) IS NOT NULL AND try_cast(y AS INT) IS NOT NULL")
    return meta.groupBy("domain", "case_id").agg(F.bool_and(ok).alias("ok")).where("ok").select("domain", "case_id")


def registered_pairs(meta: DataFrame, size: int | str, index: DataFrame | None = None, line: str = "id") -> DataFrame:
    """(case_id, id_a, id_b, how, name): tiles at one place; by equal ids in cases without valid places in both domains. `size`: of tiles, or the column that holds A's.

    Where B has a place twice the row that was read last, by `line`, counts. `index` (domain, case_id, id) lists the images that are there;
    without it all are. The name puts four neighbours into one block.
    """
    good = valid_cases(meta).groupBy("case_id").count().where("count = 2").select("case_id")
    placed = meta.join(good, "case_id", "left_semi").select("domain", "case_id", "id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col(line).alias("_line"), (F.col(size) if isinstance(size, str) else F.lit(size)).cast("int").alias("_size"))
    a = placed.where("domain = 'A'").select("case_id", "x", "y", "_size", F.col("id").alias("id_a"))
    b = placed.where("domain = 'B'").groupBy("case_id", "x", "y").agg(F.max_by("id", "_line").alias("id_b"))
    col, row = "(x div _size)", "(y div _size)"
    name = F.expr(f"concat(case_id, '_', CAST({row} div 2 AS STRING), '_', CAST({col} div 2 AS STRING), '_r', CAST({row} % 2 AS STRING), 'c', CAST({col} % 2 AS STRING))")
    one = a.join(b, ["case_id", "x", "y"]).select("case_id", "id_a", "id_b", F.lit("coordinate").alias("how"), name.alias("name"))
    rest = meta.join(good, "case_id", "left_anti")
    a = rest.where("domain = 'A'").select("case_id", "id")
    two = a.join(rest.where("domain = 'B'").select("case_id", "id"), ["case_id", "id"]).select("case_id", F.col("id").alias("id_a"), F.col("id").alias("id_b"), F.lit("id").alias("how"), F.concat("case_id", F.lit("_"), "id").alias("name"))
    both = one.unionByName(two)
    for x in "AB" if index is not None else "":
        there = index.where(F.col("domain") == x).select("case_id", F.col("id").alias(f"id_{x.lower()}"))
        both = both.join(there, ["case_id", f"id_{x.lower()}"], "left_semi")
    return both.select("case_id", "id_a", "id_b", "how", "name")


def power(kept: DataFrame, keys: list[str]) -> DataFrame:
    """For each key how many pairs were kept, pairs of a slice, and the AUROC that a slice of that size can tell from chance."""
    n = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("kept")).withColumn("per_slice", F.expr("kept div 2"))
    return n.withColumn("bar", F.expr("0.5D + 2.58D * sqrt(0.16667D / greatest(per_slice, 1))"))


def located(coordinates: DataFrame, index: DataFrame) -> DataFrame:
    """domain, case_id, id, x, y, tile_size, line of the tiles that registered_pairs() may pair: those that a case's file places, and in cases without such a file the images, without a place.

    coordinates: domain, case_id, id, x, y, tile_size, line; index: domain, case_id, id of the images that are there.
    """
    bare = index.join(coordinates.select("domain", "case_id").distinct(), ["domain", "case_id"], "left_anti").select("domain", "case_id", "id")
    # a case that one domain alone places is paired by the ids of its images
    one = coordinates.select("domain", "case_id").distinct().groupBy("case_id").count().where("count = 1").select("case_id")
    rest = index.join(one, "case_id", "left_semi").select("domain", "case_id", "id")
    none = {c: F.lit(None).cast(coordinates.schema[c].dataType) for c in ("x", "y", "tile_size", "line")}
    placed = coordinates.join(one, "case_id", "left_anti").select("domain", "case_id", "id", *none)
    return placed.unionByName(bare.unionByName(rest).distinct().withColumns(none))


def with_tissue(pairs: DataFrame, tissue: DataFrame, least: float) -> DataFrame:
    """Pairs (case_id, id_a, id_b, and more) both of whose tiles have at least `least` tissue. tissue: domain, case_id, id, tissue; a tile that isn't there counts as 1."""
    for x in "ab":
        side = tissue.where(F.col("domain") == x.upper()).select("case_id", F.col("id").alias(f"id_{x}"), F.col("tissue").alias(f"tissue_{x}"))
        pairs = pairs.join(side, ["case_id", f"id_{x}"], "left")
    shown = F.least(*[F.coalesce(f"tissue_{x}", F.lit(1.0)) for x in "ab"])
    return pairs.where(shown >= least)


def training_tiles(index: DataFrame, tissue: DataFrame, held: DataFrame | None, least: float) -> DataFrame:
    """domain, case_id, id (and more) of training images with at least `least` tissue, each side alone; without the cases of `held`. A tile that isn't in tissue counts as 1."""
    rows = index if held is None else index.join(held.select("case_id").distinct(), "case_id", "left_anti")
    shown = tissue.select("domain", "case_id", "id", F.col("tissue").alias("_shown"))
    return rows.join(shown, ["domain", "case_id", "id"], "left").where(F.coalesce("_shown", F.lit(1.0)) >= least).drop("_shown")


def report(meta: DataFrame, pairs: DataFrame, needed: bool = False) -> DataFrame:
    """For each case in both domains: tiles of A and B, pairs, and the share of pairs with equal ids. With `needed` it is an error if nothing is paired at all."""
    if needed and pairs.isEmpty():
        raise ValueError("no tile of a case is paired between the two domains; do both cover the same places of the slide?")
    counts = meta.groupBy("case_id").agg(F.count_if(F.col("domain") == "A").alias("tiles_a"), F.count_if(F.col("domain") == "B").alias("tiles_b")).where("tiles_a > 0 AND tiles_b > 0")
    found = pairs.groupBy("case_id").agg(F.count(F.lit(1)).alias("paired"), F.avg(F.when(F.col("id_a") == F.col("id_b"), 1.0).otherwise(0.0)).alias("id_agreement"))
    return counts.join(found, "case_id", "left").select("case_id", "tiles_a", "tiles_b", F.coalesce("paired", F.lit(0)).alias("paired"), "id_agreement")


def candidates(meta: DataFrame, pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Tiles to survey: all but those of held-out cases, and both sides of every pair."""
    train = meta.join(held, "case_id", "left_anti").select("domain", "case_id", "id")
    sides = [pairs.select(F.lit(x.upper()).alias("domain"), "case_id", F.col(f"id_{x}").alias("id")) for x in "ab"]
    return train.unionByName(sides[0]).unionByName(sides[1]).distinct()
