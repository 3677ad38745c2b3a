"""Stain vectors from pooled pixels: second moment, its plane, and the extremes of the angle within it."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mosaica.functions.optics import angle, od_estimation
from mosaica.operators.ordering import percentiles, ranked
from mosaica.operators.pairing import seeded
from mosaica.operators.tiling import OWN, bilinear, by_size, ready, resize, small

MIN_OD, MAX_OD, LEAST = 0.05, 1.0, 1000
#: Tiles of a domain, longest side of a tile and pixels of a tile that an estimate takes.
LIMIT, MAX_SIDE, PIXELS = 200, 256, 20_000
#: Degrees that two stains should be apart.
MIN_SEPARATION = 15.0


def sampled_tiles(tiles: DataFrame, keys: list[str], limit: int = LIMIT, seed: int = 0, name: str = "name") -> DataFrame:
    """At most `limit` tiles of each key, in an order that depends on seed and names alone; all for 0."""
    if not limit:
        return tiles
    picked = ranked(tiles.select(*keys, name, seeded(seed, name).alias("_seeded")), ["_seeded", name], "_at", keys, strict=True).where(F.col("_at") < limit)
    return tiles.join(picked.select(*keys, name), [*keys, name], "left_semi")


def tile_pixels(tiles: DataFrame, keys: list[str], name: str = "name", cap: int = PIXELS, max_side: int = MAX_SIDE, seed: int = 0) -> DataFrame:
    """Pixels (keys, r, g, b) of tiles (h, w, rgb binary): at most `cap` of a tile, in an order that depends on seed and name alone.

    A tile with a side over max_side is first made a square of that size. Sampled in one pass over the bytes, so what a tile gives is bounded.
    """

    def run(names: pa.Array, h: pa.Array, w: pa.Array, rgb: pa.Array) -> pa.Array:
        out: list = [None] * len(rgb)
        for rows, images in by_size(h, w, rgb):
            if max(images.shape[1:3]) > max_side:
                images = resize(images, max_side, bilinear)
            for i, image in zip(rows, images.reshape(len(images), -1, 3), strict=True):
                if cap and len(image) > cap:
                    rng = np.random.default_rng([seed, *str(names[int(i)].as_py()).encode()])
                    image = image[rng.choice(len(image), cap, replace=False)]
                out[i] = image.astype(np.int32).ravel()
        return pa.array(out, pa.list_(pa.int32()))

    ready(tiles.sparkSession)
    made = F.arrow_udf(run, "array<int>").asNondeterministic()(F.col(name), F.col("h"), F.col("w"), F.col("rgb"))
    place = F.explode(F.sequence(F.lit(0), F.floor(F.size("_px") / 3).cast("int") - 1)).alias("_i")
    rows = tiles.select(*keys, made.alias("_px")).where("size(_px) > 0").select(*keys, "_px", place)
    return rows.select(*keys, *[F.get("_px", 3 * F.col("_i") + j).alias(c) for j, c in enumerate("rgb")])


def sampled_pixels(pixels: DataFrame, keys: list[str], cap: int, seed: int) -> DataFrame:
    """At most `cap` pixels of a tile, in seeded order.

    Pixels are dealt by tile before they are sorted: where many come from few input rows, a task would otherwise sort all that its own rows give.
    """
    pixels = pixels.repartition(int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    w = Window.partitionBy(*keys).orderBy(seeded(seed, *keys, "y", "x"), "y", "x")
    return pixels.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def stained(pixels: DataFrame) -> DataFrame:
    """Pixels with densities o0, o1, o2 whose largest density lies within the bounds."""
    od = pixels.withColumns({f"o{i}": od_estimation(F.col(c)) for i, c in enumerate("rgb")})
    return od.where(F.greatest("o0", "o1", "o2").between(MIN_OD, MAX_OD))


def moments(od: DataFrame, keys: list[str]) -> DataFrame:
    """The second moment of the densities, not centred, and the number of pixels."""
    return od.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(f"o{i}") * F.col(f"o{j}")).alias(f"m{i}{j}") for i in range(3) for j in range(i, 3)])


def plane(m: DataFrame, keys: list[str]) -> DataFrame:
    """e1 and e2, the leading eigenvectors of each moment, turned so that their sum isn't negative."""
    kinds = ", ".join(f"{k} {m.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for pdf in batches:
            at = [[0, 1, 2], [1, 3, 4], [2, 4, 5]]
            sym = pdf[["m00", "m01", "m02", "m11", "m12", "m22"]].to_numpy()[:, at] if len(pdf) else np.zeros((0, 3, 3))
            vec = np.linalg.eigh(sym)[1]
            e = [np.where(vec[:, :, k].sum(1, keepdims=True) < 0, -1, 1) * vec[:, :, k] for k in (2, 1)]
            yield pd.DataFrame({**{k: pdf[k] for k in keys}, "n": pdf["n"], "e1": list(e[0]), "e2": list(e[1])})

    return m.mapInPandas(run, f"{kinds}, n long, e1 array<double>, e2 array<double>")


def order_like(a: Column, b: Column, reference: Column | None = None) -> tuple[Column, Column]:
    """Two stain vectors in order: the nearer to the reference first (a stays first if neither is); without one, the one with more red."""
    first = a[0] > b[0] if reference is None else angle(a, reference) <= angle(b, reference)
    return F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)


def estimate(pixels: DataFrame, keys: list[str], low: float = 0.01, high: float = 0.99, least: int = LEAST) -> DataFrame:
    """(keys, n, a, b): the two stains of each group of pixels (r, g, b), at the lower and the upper end of the angle.

    A group with fewer than `least` stained pixels is an error. Two passes over the pixels: moments, then angles.
    """
    od = stained(pixels)
    m = moments(od, keys)
    groups = pixels.select(*keys).distinct().join(m.select(*keys, "n"), keys, "left")
    lacking = groups.where(F.coalesce("n", F.lit(0)) < least).first()
    if lacking:
        raise ValueError(f"only {lacking['n'] or 0} stained pixels in {', '.join(str(lacking[k]) for k in keys)}; {least} are needed: sample more tiles, or widen the bounds")
    e = plane(m, keys)
    along = lambda v: sum((F.col(f"o{i}") * F.col(v)[i] for i in range(3)), F.lit(0.0))
    phi = od.join(e, keys).select(*keys, F.atan2(along("e2"), along("e1")).alias("phi"))
    ends = percentiles(phi, keys, "phi", [low, high], -np.pi, np.pi)

    def vector(k: int):
        raw = F.zip_with("e1", "e2", lambda a, b: F.greatest(F.lit(0.0), a * F.cos(F.col("p")[k]) + b * F.sin(F.col("p")[k])))
        norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
        return F.transform(raw, lambda x: x / F.nullif(norm, F.lit(0.0)))

    return e.join(ends, keys).select(*keys, "n", vector(0).alias("a"), vector(1).alias("b"))


def for_run(pairs: DataFrame, keys: list[str], domain: str = "domain", pin: bool = False, min_separation: float = MIN_SEPARATION) -> DataFrame:
    """One row for each key from estimate() of both domains: a1, a2, b1, b2, their separations, the angle between a1 and b1, and warnings.

    A's stains are ordered by red, B's by their angle to a1, so that first stains mean the same; with `pin` b1 is a1.
    """
    one = {x: pairs.where(F.col(domain) == x).select(*keys, F.col("a").alias(f"x{x}"), F.col("b").alias(f"y{x}")) for x in "AB"}
    a1, a2 = order_like(F.col("xA"), F.col("yA"))
    rows = one["A"].join(one["B"], keys).select(*keys, a1.alias("a1"), a2.alias("a2"), "xB", "yB")
    b1, b2 = order_like(F.col("xB"), F.col("yB"), F.col("a1"))
    rows = rows.select(*keys, "a1", "a2", b1.alias("was"), b2.alias("b2"), (F.col("a1") if pin else b1).alias("b1"))
    rows = rows.withColumns({"separation_a": angle(F.col("a1"), F.col("a2")), "separation_b": angle(F.col("b1"), F.col("b2")), "shared_angle": angle(F.col("a1"), F.col("b1")), "_moved": angle(F.col("was"), F.col("a1"))})
    close = lambda x: F.when(F.col(f"separation_{x.lower()}") < min_separation, F.format_string(f"domain {x} stains are only %.1f degrees apart", f"separation_{x.lower()}"))
    pinned = F.format_string("first stain of B replaced by that of A, which lay %.1f degrees off", "_moved") if pin else F.lit(None).cast("string")
    return rows.withColumn("warnings", F.array_compact(F.array(pinned, close("A"), close("B")))).drop("was", "_moved")


def attached(tiles: DataFrame, vectors: DataFrame, keys: tuple[str, ...] = ("marker", "domain"), needed: bool = False) -> DataFrame:
    """tiles with stain1 and stain2 of their key (null: none), from a table of stain vectors with one row for each key. Columns of these names are replaced.

    The table is broadcast where it is small, so tiles stay where they are. More than one row for a key is an error, and with `needed` a key without vectors is too.
    """
    table = vectors.select(*keys, *OWN)
    again = table.groupBy(*keys).count().where("count > 1").first()
    if again:
        raise ValueError(f"several stain vectors for {', '.join(str(again[k]) for k in keys)}")
    if needed and (lacking := tiles.select(*keys).distinct().join(table, list(keys), "left_anti").first()):
        raise ValueError(f"no stain vectors for {', '.join(str(lacking[k]) for k in keys)}")
    return tiles.drop(*OWN).join(small(table), list(keys), "left")


def vector_rows(run: DataFrame, keys: str | tuple[str, ...], source: str) -> DataFrame:
    """for_run() as the rows of a table of stain vectors: marker (the first of keys, and any others), vectors, domain, stain1, stain2, separation_deg."""
    marker, *more = (keys,) if isinstance(keys, str) else keys
    both = [F.struct(F.lit(x).alias("domain"), F.col(f"{x.lower()}1").alias("stain1"), F.col(f"{x.lower()}2").alias("stain2"), F.col(f"separation_{x.lower()}").alias("separation_deg")) for x in "AB"]
    return run.select(F.col(marker).alias("marker"), *more, F.lit(source).alias("vectors"), F.explode(F.array(*both)).alias("v")).select("marker", *more, "vectors", "v.*")
