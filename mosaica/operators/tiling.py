"""Crops, tissue, contrast, resampling and batch inference of tiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from mosaica.functions import optics
from mosaica.operators.ordering import percentiles

WHITE = 220
#: Columns of a tile's own stain vectors, and the names that they have in a field's specification.
OWN = ["stain1", "stain2"]
#: Rows of a table of keys that may be broadcast, some 100 bytes each; a larger one is joined by a shuffle.
MOST_BROADCAST = 100_000
#: Bytes of tiles that one numpy pass takes at a time.
TOGETHER = 1 << 20
#: Rows and bytes of an Arrow batch of tiles or diagrams; a larger row is one by itself.
ARROW_ROWS, ARROW_BYTES = 512, 1 << 22


def ready(spark: SparkSession) -> SparkSession:
    """The session with Arrow batches of at most ARROW_ROWS rows and some ARROW_BYTES, so that what a Python worker holds doesn't grow with a partition."""
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        if not 0 < int(spark.conf.get(f"spark.sql.execution.arrow.{name}").rstrip("bB")) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return spark


def by_size(h: pa.Array, w: pa.Array, rgb: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The tiles of an Arrow batch (rows, array of n x h x w x 3 bytes), those of one size together, in parts of bounded size; null tiles are left out."""
    size = np.stack([np.array(h.to_pylist(), object), np.array(w.to_pylist(), object)], 1)
    known = np.flatnonzero(rgb.is_valid().to_numpy(zero_copy_only=False))
    for a, b in sorted({tuple(x) for x in size[known]}):
        rows = known[(size[known] == (a, b)).all(1)]
        n = max(1, TOGETHER // max(1, a * b * 3))
        for at in range(0, len(rows), n):
            part = rows[at : at + n]
            yield part, np.stack([np.frombuffer(rgb[int(i)].as_buffer(), np.uint8).reshape(a, b, 3) for i in part])


def pooled(images: np.ndarray, k: int) -> np.ndarray:
    """k x k averages of images (n, h, w, 3); what is left at the right and bottom is dropped."""
    n, h, w, c = images.shape
    cut = images[:, : h // k * k, : w // k * k].astype(float)
    return cut.reshape(n, h // k, k, w // k, k, c).mean((2, 4)) if k > 1 else cut


def by_strips(images: np.ndarray, k: int, make: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """make(pooled(images, k)) for a `make` that takes each pixel by itself, strip by strip, so that the colours of a large tile are never all held as floats."""
    n, h, w, _ = images.shape
    rows = max(1, TOGETHER // max(1, 3 * n * w * k)) * k
    if h <= rows:
        return make(pooled(images, k))
    return np.concatenate([make(pooled(images[:, y : y + rows], k)) for y in range(0, h // k * k, rows)], 1)


def small(table: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """table, to be broadcast if it has at most `most` rows; else Spark chooses how to join it."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def by_stains(rows: np.ndarray, first: list, second: list) -> Iterator[tuple[np.ndarray, dict]]:
    """The rows that have the same two stain vectors, as places within `rows`, and these vectors by name (none where a row has none)."""
    groups: dict[tuple, list[int]] = {}
    for place, i in enumerate(rows.tolist()):
        pair = None if first[i] is None or second[i] is None else (tuple(first[i]), tuple(second[i]))
        groups.setdefault(pair, []).append(place)
    for pair, places in groups.items():
        yield np.array(places), dict(zip(OWN, pair, strict=True)) if pair else {}


def measured(tiles: DataFrame, name: str, kind: str, arrow: pa.DataType, measure: Callable[..., list], own: bool = False) -> DataFrame:
    """tiles (h, w, rgb binary, and more) with a column that `measure` makes of a stack of images: a value for each; null without pixels.

    With `own`, tiles have columns stain1 and stain2, and measure(images, vectors) gets the images of each two vectors by themselves.
    """

    def filled(h: pa.Array, w: pa.Array, rgb: pa.Array, parts: Callable) -> pa.Array:
        out: list = [None] * len(rgb)
        for rows, images in by_size(h, w, rgb):
            for places, values in parts(rows, images):
                for i, v in zip(rows[places], values, strict=True):
                    out[i] = v
        return pa.array(out, arrow)

    def alike(h: pa.Array, w: pa.Array, rgb: pa.Array) -> pa.Array:
        return filled(h, w, rgb, lambda rows, images: [(slice(None), measure(images))])

    def each(h: pa.Array, w: pa.Array, rgb: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        one, two = first.to_pylist(), second.to_pylist()
        return filled(h, w, rgb, lambda rows, images: [(p, measure(images[p], v)) for p, v in by_stains(rows, one, two)])

    ready(tiles.sparkSession)
    made = F.arrow_udf(each if own else alike, kind).asNondeterministic()
    return tiles.withColumn(name, made(*map(F.col, ["h", "w", "rgb", *(OWN if own else [])])))


def crop_grid(images: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """One row for each crop of images (h, w): grid_row, grid_col, top, left. What is left at the right and bottom is dropped."""
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the tile")
    step = size - overlap
    fits = images.where((F.col("h") >= size) & (F.col("w") >= size))
    places = lambda side: F.sequence(F.lit(0), F.col(side) - size, F.lit(step))
    rows = fits.select("*", F.posexplode(places("h")).alias("grid_row", "top"))
    return rows.select("*", F.posexplode(places("w")).alias("grid_col", "left"))


def crop_estimate(images: DataFrame, size: int, resize: int, overlap: int = 0) -> DataFrame:
    """For each split (name, h, w of its images): crops if all are like the first by name, the unused edge (no overlap only) and the scale."""
    step = size - overlap
    first = images.groupBy("split").agg(F.count(F.lit(1)).alias("n_images"), F.min_by(F.struct("h", "w"), "name").alias("f"))
    along = lambda s: F.greatest(F.lit(0), F.floor((F.col(f"f.{s}") - size) / F.lit(step)) + 1)
    edge = F.col("f.h") % size + F.col("f.w") % size if not overlap else F.lit(0)
    return first.select("split", "n_images", (F.col("n_images") * along("h") * along("w")).alias("crops"), edge.cast("int").alias("edge"), F.lit(size / resize).alias("scale"))


def tissue(tiles: DataFrame, white: int = WHITE) -> DataFrame:
    """tiles with `tissue`, the share of pixels darker than `white`; null for a tile without pixels."""

    def share(images: np.ndarray) -> list:
        level = images.astype(np.int32) @ np.array([19595, 38470, 7471], np.int32) + 32768 >> 16
        return (level < white).mean((1, 2)).tolist()

    return measured(tiles, "tissue", "double", pa.float64(), share)


#: Shares of tissue that a survey counts under.
UNDER = (0.01, 0.05, 0.10, 0.25, 0.50)


def survey(t: DataFrame, keys: list[str]) -> DataFrame:
    """For each key deciles of tissue (k = 0..10), and how many tiles, and which share of them, lie under each of UNDER. Tiles without pixels count as 0."""
    t = t.select(*keys, F.coalesce("tissue", F.lit(0.0)).alias("tissue"))
    name = lambda u: f"{round(u * 100):02d}"
    under = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("tissue") < u).alias(f"under_{name(u)}") for u in UNDER])
    rows = percentiles(t, keys, "tissue", [k / 10 for k in range(11)], 0.0, 1.0).join(under, keys).select("*", F.posexplode("p").alias("k", "decile"))
    return rows.select(*keys, F.col("k").cast("long").alias("k"), "decile", *[f"under_{name(u)}" for u in UNDER], *[(F.col(f"under_{name(u)}") / F.col("n")).alias(f"share_{name(u)}") for u in UNDER])


def stretched(tiles: DataFrame, spec: str = "gray", combine: str = "max", vectors: dict | None = None, k: int = 1, inverted: bool = False, own: bool = False) -> DataFrame:
    """tiles with `levels`: the field of k x k averages row by row, between its tile's 0.5 and 99.5 percentiles, on 0..1. With `own` by each tile's own stains."""

    def levels(images: np.ndarray, held: dict | None = None) -> list:
        v = optics.field_array(spec, pooled(images, k), combine, held or vectors).reshape(len(images), -1)
        v = -v if inverted else v
        lo, hi = np.percentile(v, [0.5, 99.5], axis=1)
        return list(np.clip((v - lo[:, None]) / np.where(hi <= lo, 1e-6, hi - lo)[:, None], 0, 1))

    return measured(tiles, "levels", "array<double>", pa.list_(pa.float64()), levels, own)


def rendered(tiles: DataFrame, spec: str, combine: str = "max", vectors: dict | None = None, own: bool = False) -> DataFrame:
    """tiles with `levels`: the concentration that a spec names as 8-bit levels, dark where it is strong, row by row. With `own` by each tile's own stains."""

    def levels(images: np.ndarray, held: dict | None = None) -> list:
        c = optics.field_array(spec, images.astype(float), combine, held or vectors).reshape(len(images), -1)
        return list(np.clip(np.rint(255.0 * 10.0 ** -np.maximum(c, 0.0)), 0, 255).astype(np.int32))

    return measured(tiles, "levels", "array<int>", pa.list_(pa.int32()), levels, own)


def downsampled(tiles: DataFrame, k: int) -> DataFrame:
    """tiles with `pooled`: array<array<double>>, the k x k averages of each colour, row by row."""
    kind = pa.list_(pa.list_(pa.float64()))
    return measured(tiles, "pooled", "array<array<double>>", kind, lambda images: [list(x.reshape(-1, 3).T) for x in pooled(images, k)])


def pending(wanted: DataFrame, done: DataFrame, key: str | list[str], limit: int = 0) -> DataFrame:
    """What is wanted and not done yet, in order of the key; done rows don't count against the limit (0: none)."""
    rest = wanted.join(done, key, "left_anti")
    return rest.orderBy(*([key] if isinstance(key, str) else key)).limit(limit) if limit else rest


def _weights(n: int, m: int, kernel: Callable[[np.ndarray], np.ndarray], support: float) -> np.ndarray:
    """Rows of weights that resample n values to m; the kernel is widened when shrinking."""
    scale = n / m
    wide = max(scale, 1.0)
    center = (np.arange(m) + 0.5) * scale
    at = np.arange(n) + 0.5
    x = (at - center[:, None]) / wide
    w = np.where(np.abs(x) < support, kernel(x), 0)
    return w / w.sum(1, keepdims=True)


def lanczos(n: int, m: int) -> np.ndarray:
    return _weights(n, m, lambda x: np.sinc(x) * np.sinc(x / 3), 3)


def bilinear(n: int, m: int) -> np.ndarray:
    return _weights(n, m, lambda x: np.maximum(0, 1 - np.abs(x)), 1)


def resize(images: np.ndarray, size: int, weights: Callable[[int, int], np.ndarray]) -> np.ndarray:
    """A stack of images (n, h, w, 3 bytes) made square."""
    _, h, w, _ = images.shape
    out = np.einsum("ih,nhwc,jw->nijc", weights(h, size), images.astype(float), weights(w, size), optimize=True)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def resized(tiles: DataFrame, size: int, weights: Callable[[int, int], np.ndarray] = lanczos) -> DataFrame:
    """tiles (h, w, rgb binary, and more) with square images of `size`; those of that size already stay as they are, null ones null."""

    def square(images: np.ndarray) -> list:
        return [x.tobytes() for x in (images if images.shape[1:3] == (size, size) else resize(images, size, weights))]

    return measured(tiles, "rgb", "binary", pa.binary(), square).withColumns({c: F.lit(size).cast(tiles.schema[c].dataType) for c in "hw"})


def loaded(tiles: DataFrame, size: int) -> DataFrame:
    """tiles with `x`: the image made square by bilinear resampling where it isn't, on -1..1, row by row, colour by colour (all red, then green, then blue)."""

    def scaled(images: np.ndarray) -> list:
        images = images if images.shape[1:3] == (size, size) else resize(images, size, bilinear)
        return list((images.astype(float) / 127.5 - 1).transpose(0, 3, 1, 2).reshape(len(images), -1))

    return measured(tiles, "x", "array<double>", pa.list_(pa.float64()), scaled)


def cropped(images: DataFrame, size: int, overlap: int = 0, done: DataFrame | None = None) -> DataFrame:
    """The crops of images (h, w, rgb binary, and more): grid_row, grid_col, top, left, and h, w and rgb of the crop. Crops of an image are cut in the task that holds it.

    Places that `done` (columns of images, grid_row, grid_col) lists are not cut again.
    """
    places = crop_grid(images.select(*[c for c in images.columns if c != "rgb"], "rgb"), size, overlap)
    if done is not None:
        places = places.join(small(done), done.columns, "left_anti")

    def run(w: pa.Array, rgb: pa.Array, top: pa.Array, left: pa.Array) -> pa.Array:
        out = []
        for a, b, y, x in zip(w.to_pylist(), rgb, top.to_pylist(), left.to_pylist(), strict=True):
            image = np.frombuffer(b.as_buffer(), np.uint8).reshape(-1, a, 3) if b.is_valid else None
            out.append(None if image is None else image[y : y + size, x : x + size].tobytes())
        return pa.array(out, pa.binary())

    ready(images.sparkSession)
    made = F.arrow_udf(run, "binary").asNondeterministic()(F.col("w"), F.col("rgb"), F.col("top"), F.col("left"))
    return places.withColumn("rgb", made).withColumns({"h": F.lit(size), "w": F.lit(size)})


def translate(tiles: DataFrame, tile: str, make_model: Callable[[], Callable[[np.ndarray], np.ndarray]], values: int, batch: int = 64) -> DataFrame:
    """tiles with `out`: the model's answer to arrays of `values` numbers on -1..1, brought to 0..1 and clamped; null for a null array.

    The model is made once in each Python worker and gets `batch` tiles at a time as an array (tiles, values); it answers with one of as many rows.
    """

    def make() -> Callable[[np.ndarray], np.ndarray]:
        model = make_model()
        return lambda x: np.clip((np.asarray(model(np.asarray(x, float).reshape(len(x), values)), float).reshape(len(x), -1) + 1) / 2, 0, 1)

    kind = tiles.schema[tile].dataType.elementType.simpleString()
    none = F.array_repeat(F.lit(0).cast(kind), values)  # batches can't hold nulls
    answer = predict_batch_udf(make, return_type=ArrayType(DoubleType()), batch_size=batch, input_tensor_shapes=[[values]])
    return tiles.withColumn("out", F.when(F.col(tile).isNotNull(), answer(F.coalesce(tile, none))))
