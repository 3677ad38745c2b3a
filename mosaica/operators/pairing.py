"""Pairs of two domains, wrong partners, seeded samples and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mosaica.operators.ordering import ranked

SLIDE = r"_r\d+c\d+$"


def seeded(seed: int, *names: str) -> Column:
    """A key whose order depends on the seed and the names alone."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(n).cast("string") for n in names]))


def slide_of(stem: str, pattern: str = SLIDE) -> Column:
    return F.regexp_replace(stem, pattern, "")


def matched_pairs(tiles: DataFrame) -> DataFrame:
    """(marker, stem, a, b): the tiles of A and B with one stem; where a stem is there twice the last name counts.

    A marker none of whose stems is shared is paired by the order of names up to the shorter side.
    """
    one = tiles.groupBy("marker", "stem").agg(F.max(F.when(F.col("domain") == "A", F.col("name"))).alias("a"), F.max(F.when(F.col("domain") == "B", F.col("name"))).alias("b"))
    stems = one.where("a is not null and b is not null").withColumn("how", F.lit("stem"))
    if one.groupBy("marker").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n")).where("n = 0").isEmpty():
        return stems
    left = ranked(tiles.join(stems.select("marker").distinct(), "marker", "left_anti").select("marker", "domain", "stem", "name"), ["name"], "nth", ["marker", "domain"])
    a, b = left.where("domain = 'A'").select("marker", "nth", F.col("stem"), F.col("name").alias("a")), left.where("domain = 'B'").select("marker", "nth", F.col("name").alias("b"))
    return stems.unionByName(a.join(b, ["marker", "nth"]).select("marker", "stem", "a", "b", F.lit("order").alias("how")))


def sampled(pairs: DataFrame, seed: int, offset: int = 0, limit: int = 0, sample: str = "random") -> DataFrame:
    """pairs with pair_idx, within a marker in an order that depends on seed and stem alone, or in that of names if `sample` is head.

    A slice of it where limit is over 0.
    """
    if sample not in ("random", "head"):
        raise ValueError(f"sample must be random or head, not {sample!r}")
    key = "_seeded"
    keyed = pairs.withColumn(key, seeded(seed, "stem") if sample == "random" else F.lit(""))
    out = ranked(keyed, [key, "stem"], "pair_idx", ["marker"], strict=True).drop(key)  # a pair for each stem
    return out.where((F.col("pair_idx") >= offset) & ((F.lit(limit) == 0) | (F.col("pair_idx") < offset + limit)))


def halves(pairs: DataFrame) -> DataFrame:
    """pairs with `half`, the length of a slice where it is not given: half of a marker's pairs, at least one."""
    n = pairs.groupBy("marker").agg(F.greatest(F.lit(1).cast("long"), F.expr("count(1) div 2")).alias("half"))
    return pairs.join(n, "marker")


def strict_partners(pairs: DataFrame, seed: int, shuffles: int) -> DataFrame:
    """(marker, shuffle_no, pair_idx, partner_idx): another pair of the same slide, by a rotation of 1..n-1 places; lone pairs are left out."""
    w = Window.partitionBy("marker", "slide")
    ranked = pairs.select("marker", "slide", "pair_idx", (F.row_number().over(w.orderBy("pair_idx")) - 1).alias("rn"), F.count(F.lit(1)).over(w).alias("n")).where("n > 1")
    each = ranked.withColumn("shuffle_no", F.explode(F.sequence(F.lit(0), F.lit(shuffles - 1))))
    digit = F.conv(F.substring(seeded(seed, "slide", "shuffle_no"), 1, 8), 16, 10).cast("long")
    turned = each.withColumn("to", (F.col("rn") + 1 + digit % (F.col("n") - 1)) % F.col("n"))
    other = ranked.select("marker", "slide", F.col("rn").alias("to"), F.col("pair_idx").alias("partner_idx"))
    return turned.join(other, ["marker", "slide", "to"]).select("marker", "shuffle_no", "pair_idx", "partner_idx")


def free_partners(pairs: DataFrame, seed: int, shuffles: int) -> DataFrame:
    """Like strict_partners over all pairs of a marker: each one's partner is the next in a seeded circle; a lone pair is its own."""
    each = pairs.select("marker", "pair_idx", F.explode(F.sequence(F.lit(0), F.lit(shuffles - 1))).alias("shuffle_no"))
    each = each.withColumn("_seeded", seeded(seed, "pair_idx", "shuffle_no"))
    circle = ranked(each, ["_seeded", "pair_idx"], "at", ["marker", "shuffle_no"], strict=True).drop("_seeded")
    n = circle.groupBy("marker", "shuffle_no").agg(F.count(F.lit(1)).alias("n"))
    here = circle.join(n, ["marker", "shuffle_no"]).withColumn("at", (F.col("at") + 1) % F.col("n"))
    return here.join(circle.withColumnRenamed("pair_idx", "partner_idx"), ["marker", "shuffle_no", "at"]).select("marker", "shuffle_no", "pair_idx", "partner_idx")


def holdout(tiles: DataFrame, share: float, seed: int) -> DataFrame:
    """tiles with `split`: of the sources in both domains max(1, round(n * share)) go to val, with all their tiles (half-even rounding).

    A marker without a source in both domains is an error.
    """
    both = tiles.groupBy("marker", "slide").agg(F.countDistinct("domain").alias("d")).where("d = 2")
    order = ranked(both.select("marker", "slide", seeded(seed, "slide").alias("_seeded")), ["_seeded", "slide"], "nth", ["marker"], strict=True)
    n = order.groupBy("marker").agg(F.count(F.lit(1)).alias("n"))
    lacking = tiles.select("marker").distinct().join(n, "marker", "left_anti").first()
    if lacking:
        raise ValueError(f"no source is shared by both domains of {lacking['marker']!r}")
    val = order.join(n, "marker").where(F.col("nth") < F.greatest(F.lit(1), F.bround(F.col("n") * share))).select("marker", "slide", F.lit(True).alias("val"))
    return tiles.join(val, ["marker", "slide"], "left").withColumn("split", F.when(F.col("val"), "val").otherwise("train")).drop("val")
