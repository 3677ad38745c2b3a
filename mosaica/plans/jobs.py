"""The jobs that users call, composed of the operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaica.functions import optics
from mosaica.operators import pairing, persistence, registration, reports, scoring, stains, sweep, tiling
from mosaica.sources import images as sources
from mosaica.sources.scratch import stored


def ingest_tiles(images: DataFrame, marker: str, out: str, size: int, overlap: int = 0, resize_to: int = 0, tissue_threshold: float = 0.0, white: int = tiling.WHITE) -> DataFrame:
    """Cuts images into tiles, drops background, resamples, and adds the tiles to the folder `out` by marker, split and domain.

    images: origin, name, h, w, rgb, valid, split (such as trainA). Background is dropped before resampling. Returns split, images, written and skipped.
    An image that can't be decoded counts as one without crops. Tiles that an earlier run with the same size, overlap and resampling wrote are neither cut nor written
    again, so a run that is repeated, or taken up again, leaves the folder and the counts as one run does.
    """
    spark, made = images.sparkSession, {"tile_size": size, "overlap": overlap, "resize_to": resize_to}
    stem = F.regexp_replace("name", r"\.[^.]+$", "")
    named = images.where("valid").select("origin", "split", stem.alias("source_stem"), "h", "w", "rgb")

    def there() -> DataFrame:
        rows = spark.read.schema(TILES).parquet(out).where(F.col("marker") == marker)
        return rows.where(" AND ".join(f"{k} = {v}" for k, v in made.items())).select(F.concat("split", "domain").alias("split"), "origin", "grid_row", "grid_col")

    crops = tiling.cropped(named, size, overlap, there() if sources.exists(spark, out) else None)
    if tissue_threshold:
        crops = tiling.tissue(crops, white).where(F.col("tissue") >= tissue_threshold).drop("tissue")
    if resize_to:
        crops = tiling.resized(crops, resize_to)
    place = F.format_string("_r%dc%d", "grid_row", "grid_col")
    tiles = crops.select(
        F.lit(marker).alias("marker"), F.expr("left(split, length(split) - 1)").alias("split"), F.right("split", F.lit(1)).alias("domain"), "origin", "source_stem",
        F.concat("source_stem", place).alias("stem"), F.col("source_stem").alias("slide"), "grid_row", "grid_col", *[F.lit(v).alias(k) for k, v in made.items()], "h", "w", "rgb",
    )
    tiles.write.mode("append").partitionBy("marker", "split", "domain").parquet(out)
    written = there().groupBy("split", "origin").agg(F.count(F.lit(1)).alias("written"))
    # how many crops an image has follows from its size, so nothing is cut again
    step = size - overlap
    along = lambda c: F.greatest(F.lit(0), F.floor((F.col(c) - size) / F.lit(step)) + 1)
    grid = images.select("origin", "split", F.when(F.col("valid"), along("h") * along("w")).otherwise(0).alias("crops"))
    by = grid.join(written, ["split", "origin"], "left").withColumn("written", F.coalesce("written", F.lit(0)))
    return by.groupBy("split").agg(F.count(F.lit(1)).alias("images"), F.sum("written").alias("written"), F.sum(F.col("crops") - F.col("written")).alias("skipped"))


#: The tiles that ingest_tiles() writes.
TILES = "origin string, source_stem string, stem string, slide string, grid_row int, grid_col int, tile_size int, overlap int, resize_to int, h int, w int, rgb binary, marker string, split string, domain string"


def register_cases(spark: SparkSession, folders: dict[str, str], out: str, min_tissue: float = 0.05, white: int = tiling.WHITE, exclude_val_cases: bool = False) -> dict[str, DataFrame]:
    """Registers the images of case folders: validation tiles of two domains are paired by their place on the slide, background goes, and what is kept is written to `out` by split and domain.

    folders: for trainA, trainB, valA and valB a folder that holds CASE/images/ID.ext and perhaps CASE/tiles_metadata.csv. A validation case whose file can't be used in
    one of the domains is paired by ids. Pairs stay if both tiles have `min_tissue`, training tiles each by itself; with exclude_val_cases training does without cases that
    both validation domains have. An image that can't be decoded has no tissue. Nothing paired at all is an error. A second run replaces what the first wrote.

    Returns pairs, report (by case), overlap (cases of training and validation), survey (tissue of all tiles that may be used), counts (tiles by split and domain) and power.
    """
    images = {x: stored(sources.image_files(spark, f)) for x, f in folders.items()}
    both = lambda kind: reduce(DataFrame.unionByName, [images[f"{kind}{d}"].withColumn("domain", F.lit(d)) for d in "AB"])
    train, val = both("train"), both("val")
    placed = reduce(DataFrame.unionByName, [sources.case_coordinates(spark, folders[f"val{d}"]).withColumn("domain", F.lit(d)) for d in "AB"])
    shared = val.where("domain = 'A'").select("case_id").intersect(val.where("domain = 'B'").select("case_id"))
    meta = stored(registration.located(placed, val).join(shared, "case_id", "left_semi"))
    pairs = stored(registration.registered_pairs(meta, "tile_size", val, "line"))
    report = registration.report(val, pairs, needed=True)
    used = registration.candidates(train, pairs, shared if exclude_val_cases else shared.limit(0))
    # an id may stand in training and in validation, so tiles are known by their file from here on
    files = train.withColumn("kind", F.lit("train")).unionByName(val.withColumn("kind", F.lit("val")))
    used = files.join(used, ["domain", "case_id", "id"], "left_semi")
    decoded = reduce(DataFrame.unionByName, [sources.images(spark, f) for f in folders.values()]).withColumn("origin", _path("origin"))
    seen = stored(tiling.tissue(decoded, white).select("origin", F.coalesce("tissue", F.lit(0.0)).alias("tissue")))
    tissue = stored(used.withColumn("origin", _path("origin")).join(seen, "origin", "left").withColumn("tissue", F.coalesce("tissue", F.lit(0.0))))
    of = lambda kind: tissue.where(F.col("kind") == kind).select("domain", "case_id", "id", "tissue")
    kept = stored(registration.with_tissue(pairs, of("val"), min_tissue))
    trained = registration.training_tiles(train, of("train"), shared if exclude_val_cases else None, min_tissue)
    named = trained.select(F.lit("train").alias("split"), "domain", _path("origin").alias("origin"), F.concat_ws("_", "case_id", "id").alias("stem"))
    for x in "ab":
        side = kept.select("case_id", F.col(f"id_{x}").alias("id"), "name").join(val.where(F.col("domain") == x.upper()), ["case_id", "id"])
        named = named.unionByName(side.select(F.lit("val").alias("split"), "domain", _path("origin").alias("origin"), F.col("name").alias("stem")))
    named = stored(named)
    # pixels are read once more, for what is kept alone
    tiles = named.join(decoded.where("valid").select("origin", "h", "w", "rgb"), "origin")
    extension = F.regexp_extract("origin", r"(\.[^./]+)$", 1)
    tiles.withColumn("name", F.concat("stem", extension)).write.mode("overwrite").partitionBy("split", "domain").parquet(out)
    counts = named.groupBy("split", "domain").agg(F.count(F.lit(1)).alias("tiles"))
    overlap = train.select("case_id").intersect(shared).withColumn("excluded", F.lit(exclude_val_cases))
    power = registration.power(kept.withColumn("of", F.lit("all")), ["of"]).drop("of")
    return {"pairs": kept, "report": report, "overlap": overlap, "survey": tiling.survey(tissue.withColumn("of", F.lit("all")), ["of"]).drop("of"), "counts": counts, "power": power}


def _path(origin: str) -> F.Column:
    """A file's path without its scheme, which Spark's readers write in several ways."""
    return F.regexp_replace(origin, "^[a-z]+:/*", "/")


def estimate_stains(tiles: DataFrame, source: str = "estimated", limit: int = stains.LIMIT, pixels: int = stains.PIXELS, max_side: int = stains.MAX_SIDE, seed: int = 0, pin: bool = False, keys: tuple[str, ...] = ("marker",), least: int = stains.LEAST) -> tuple[DataFrame, DataFrame]:
    """(run, vectors): for_run() of each marker, and its rows of the table of stain vectors. tiles: marker, domain, name, h, w, rgb. `keys` may name more columns, for an estimate of each."""
    by = [*keys, "domain"]
    picked = stains.tile_pixels(stains.sampled_tiles(tiles, by, limit, seed), by, "name", pixels, max_side, seed)
    run = stored(stains.for_run(stains.estimate(stored(picked), by, least=least), list(keys), pin=pin))
    return run, stains.vector_rows(run, keys, source)


def estimate_and_score(train: DataFrame, val: DataFrame, chosen: list[tuple] | None = None, estimate: dict | None = None, **scored) -> dict[str, DataFrame]:
    """Estimates each marker's stain vectors on training tiles and scores settings by them on validation tiles: run, vectors and scores.

    train, val: marker, domain, stem, name, h, w, rgb. A tile (marker, domain, stem) that both have is an error, and so is a marker of val that train lacks: vectors
    must not have seen what they are judged on. Without `chosen` the grid of estimated vectors is swept. `estimate` and `scored` go to estimate_stains() and score_fields().
    """
    tile = ["marker", "domain", "stem"]
    seen = train.select(*tile).join(val.select(*tile), tile, "left_semi").first()
    if seen:
        raise ValueError(f"{seen['stem']!r} of {seen['marker']}, domain {seen['domain']}, is in both splits")
    run, vectors = estimate_stains(train, **(estimate or {}))
    vectors = stored(vectors)
    scores = sweep.score_fields(val, chosen or sweep.settings(*ESTIMATED_FIELDS), vectors=vectors, **scored)
    return {"run": run, "vectors": vectors, "scores": scores.withColumn("vectors", F.lit("estimated"))}


#: The fields of both domains and the downsamplings that are swept with estimated vectors, and with those of the literature.
ESTIMATED_FIELDS = (["stain1/stain2", "stain2/stain1", "stain1+stain2"], ["stain1/stain2", "stain2/stain1", "stain1+stain2"], [1, 2, 4])
LITERATURE_FIELDS = (["hematoxylin/eosin", "eosin/hematoxylin", "hematoxylin+eosin"], ["hematoxylin/dab", "dab/hematoxylin", "hematoxylin+dab"], [1, 2, 4])


def audit(
    tiles: DataFrame,
    sources_: dict[str, tuple[list[tuple], dict | DataFrame | None]],
    seed: int = 0,
    shuffles: int = 1,
    limit: int = 0,
    combine: str = "sum",
    scores_path: str | None = None,
    decimals: int | None = None,
    image_size: int = 0,
    invert: bool = True,
) -> dict[str, DataFrame]:
    """The decision for each marker: screen settings on the first slice, confirm the best strict ones on the second, decide by these alone.

    sources_: for each source of vectors the settings to sweep and the vectors: those of both domains, a table of them by marker and domain, or None for the literature's.
    `limit` 0 makes slices of half of each marker's own pairs. Returns screen, confirmed, decided, verdicts, arms and tally; with scores_path the scores are
    written there too. A marker without pairs, or without vectors where settings need them, is an error.
    """
    pairs = sweep.sampled_pairs(tiles, seed)
    pairs = pairing.halves(pairs) if not limit else pairs.withColumn("half", F.lit(limit).cast("long"))
    pairs = stored(pairs.where(F.col("pair_idx") < 2 * F.col("half")))
    lengths = pairs.select("marker", "half").distinct()
    slices = [pairs.where(F.floor(F.col("pair_idx") / F.col("half")) == k) for k in (0, 1)]
    made = {n: sweep.pair_diagrams(tiles, pairs, chosen, combine, vectors, image_size, invert) for n, (chosen, vectors) in sources_.items()}

    def score(name: str, chosen: list[tuple], control: str, k: int) -> DataFrame:
        rows = sweep.pair_scores(slices[k], made[name], chosen, control, shuffles, seed, decimals).join(lengths, "marker")  # a row for each marker
        rows = rows.withColumns({"vectors": F.lit(name), "offset": k * F.col("half"), "limit": F.col("half")}).drop("half")
        return sweep.with_run(rows, {"sample": "random", "slide_regex": pairing.SLIDE if control == "strict" else None, "image_size": image_size, "invert": invert, "field_combine": combine})

    all_of = lambda rows: reduce(DataFrame.unionByName, rows)
    screen = stored(all_of([score(n, chosen, control, 0) for n, (chosen, _) in sources_.items() for control in ("strict", "unstratified")]))
    # written down before the second slice is looked at, so that this can't influence it
    best = stored(scoring.top_candidates(screen).select("marker", "vectors", *scoring.SETTING))
    again = []
    for name in sources_:
        own = best.where(F.col("vectors") == name)
        chosen = sorted({tuple(r) for r in own.select(*scoring.SETTING).distinct().collect()})  # TOP_K for each marker
        if chosen:
            again.append(score(name, chosen, "strict", 1).join(own, ["marker", "vectors", *scoring.SETTING], "left_semi"))
    second = stored(all_of(again)) if again else screen.limit(0)
    if scores_path:
        sources.append_scores(screen.withColumn("stage", F.lit("screen")).unionByName(second.withColumn("stage", F.lit("confirm"))), scores_path)
    confirmed = stored(reports.confirm_set(screen, second))
    decided = stored(scoring.decided(confirmed))
    return {"screen": screen, "second": second, "confirmed": confirmed, "decided": decided, "verdicts": scoring.verdicts(decided), "arms": scoring.arms(screen), "tally": scoring.tally(decided)}


def infer_tiles(tiles: DataFrame, out: str, make_model: Callable, direction: str = "A2B", size: int = 256, limit: int = 0, batch: int = 64) -> DataFrame:
    """Runs a user's model over the tiles of the source domain and writes marker, direction, stem and out, the translated tile on 0..1 colour by colour, to the folder `out`.

    tiles: marker, domain, stem, h, w, rgb. The model gets tiles of size x size on -1..1, `batch` at a time (tiling.translate()). Tiles whose result lies there
    don't count against `limit` (0: all) and are not run again, so a repeated run makes no call. Returns the tiles this run did.
    """
    if direction not in ("A2B", "B2A"):
        raise ValueError(f"direction must be A2B or B2A, not {direction!r}")
    spark, key = tiles.sparkSession, ["marker", "stem"]
    some = tiles.where(F.col("domain") == direction[0])
    if sources.exists(spark, out):
        done = spark.read.schema(INFERRED).parquet(out).where(F.col("direction") == direction).select(*key)
    else:
        done = spark.createDataFrame([], "marker string, stem string")
    # which tiles are run is told by their keys, so that the bytes of no other tile move
    todo = stored(tiling.pending(some.select(*key), done, key, limit))
    if not todo.isEmpty():
        rows = tiling.loaded(some.join(tiling.small(todo), key, "left_semi"), size)
        made = tiling.translate(rows.select(*key, "x"), "x", make_model, 3 * size * size, batch)
        made.select("stem", "out", "marker", F.lit(direction).alias("direction")).write.mode("append").partitionBy("marker", "direction").parquet(out)
    return todo


#: The tiles that infer_tiles() writes.
INFERRED = "stem string, out array<double>, marker string, direction string"


def inspect_pairs(
    tiles: DataFrame,
    spec_a: str,
    spec_b: str,
    pairs: int,
    seed: int = 0,
    downsample: int = 1,
    combine: str = "sum",
    projection: str = "auto",
    vectors: dict | DataFrame | str | None = None,
    least: int = stains.LEAST,
    image_size: int = 0,
) -> dict[str, DataFrame]:
    """Tables about the first `pairs` pairs of each marker, in the seeded order: channels (both stains and, of merged ones, their sum, as 8-bit levels), fields (stretched), diagrams, distances.

    tiles: marker, domain, stem, name, h, w, rgb. `vectors`: each domain's stains, a table of them by marker and domain, "pair" for an estimate from each pair's own
    two tiles (of at least `least` stained pixels each, all of them; their table is returned too), or None for the literature's. Diagrams name the pixels of births and deaths.
    """
    chosen = stored(pairing.sampled(pairing.matched_pairs(tiles), seed, 0, pairs))
    sides = {"A": (spec_a, "a"), "B": (spec_b, "b")}
    fixed = vectors if isinstance(vectors, dict) else None
    named = {d: tiles.where(F.col("domain") == d).join(chosen.select("marker", "pair_idx", F.col(c).alias("name")), ["marker", "name"]) for d, (_, c) in sides.items()}
    if image_size:
        named = {d: tiling.resized(rows, image_size, tiling.bilinear) for d, rows in named.items()}
    named, extra = {d: stored(rows) for d, rows in named.items()}, {}
    own = vectors is not None and fixed is None
    if own:
        keys = ("marker", "pair_idx") if isinstance(vectors, str) else ("marker",)
        if isinstance(vectors, str):
            if vectors != "pair":
                raise ValueError(f"vectors must be a table, a dict, None or 'pair', not {vectors!r}")
            vectors = extra["vectors"] = stored(estimate_stains(named["A"].unionByName(named["B"]), "pair", limit=0, pixels=0, seed=seed, keys=keys, least=least)[1])
        named = {d: stored(stains.attached(rows, vectors, (*keys, "domain"), needed=True)) for d, rows in named.items()}
    literal = lambda d: (fixed or {}).get(d)
    channels, fields = [], []
    for d, (spec, _) in sides.items():
        specs = [*optics.split_specs(spec), *([spec] if "+" in spec else [])] if "+" in spec or "/" in spec else []
        channels += [tiling.rendered(named[d], s, combine, literal(d), own).select("marker", "pair_idx", "domain", F.lit(s).alias("channel"), "h", "w", "levels") for s in specs]
        fields.append(tiling.stretched(named[d], spec, combine, literal(d), downsample, True, own).select("marker", "pair_idx", "domain", F.lit(spec).alias("field"), F.expr(f"h div {downsample}").alias("h"), F.expr(f"w div {downsample}").alias("w"), "levels"))
    keys = ["marker", "pair_idx", "domain"]
    made = stored(persistence.tile_diagrams(named["A"].unionByName(named["B"]), {"A": [spec_a], "B": [spec_b]}, [downsample], combine=combine, vectors=fixed, own=own, places=True).select(*keys, "diagrams"))
    rows = persistence.diagram_rows(made, keys, places=True)
    one = F.col("diagrams")[0]["d"]
    packed = made.select(*keys, F.struct(*[persistence.projected_lists(one, projection, k).alias(f"p{k}") for k in (0, 1)]).alias("g"))
    a, b = (packed.where(F.col("domain") == d).select("marker", "pair_idx", F.col("g").alias(c)) for d, (_, c) in sides.items())
    out = {"fields": reduce(DataFrame.unionByName, fields), "diagrams": rows, "distances": reports.inspected(a.join(b, ["marker", "pair_idx"])).drop("a", "b")} | extra
    return out | ({"channels": reduce(DataFrame.unionByName, channels)} if channels else {})
