"""Image tiles derived from the `embeddings` and `lineitem` tables, as SQL text that Spark and DuckDB share.

`@AT(array, i)` stands for element i from 0; each engine gets its own function.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaica.operators.tiling import ready
from mosaica.sources.scratch import stored

TILES = """
SELECT vec_id, element AS domain,
       CASE CAST(floor(vec_id / 4) AS INT) % 3 WHEN 0 THEN 'ER' WHEN 1 THEN 'Ki67' ELSE 'PR' END AS marker,
       concat('s', lpad(CAST(CAST(floor(vec_id / 4) AS INT) AS STRING), 6, '0')) AS slide,
       CAST(floor((vec_id % 4) / 2) AS INT) AS grid_row, CAST(vec_id % 2 AS INT) AS grid_col,
       concat('s', lpad(CAST(CAST(floor(vec_id / 4) AS INT) AS STRING), 6, '0'), '_r',
              CAST(CAST(floor((vec_id % 4) / 2) AS INT) AS STRING), 'c', CAST(CAST(vec_id % 2 AS INT) AS STRING)) AS stem
FROM embeddings CROSS JOIN (VALUES ('A'), ('B')) d(element)
WHERE NOT (element = 'B' AND vec_id % 17 = 16)"""

PIXELS = """
WITH n AS (SELECT count(*) AS n FROM embeddings),
ab AS (
  SELECT a.vec_id, 'A' AS domain, a.embedding AS e, a.embedding AS f, CAST(0.0 AS DOUBLE) AS w FROM embeddings a
  UNION ALL
  SELECT a.vec_id, 'B' AS domain, a.embedding AS e, b.embedding AS f, CAST(0.25 AS DOUBLE) AS w
  FROM embeddings a CROSS JOIN n JOIN embeddings b ON b.vec_id = (a.vec_id + 1) % n.n WHERE a.vec_id % 17 <> 16),
v AS (
  SELECT vec_id, domain, CAST(p AS INT) AS p,
         (1 - w) * CAST(@AT(e, p) AS DOUBLE) + w * CAST(@AT(f, p) AS DOUBLE) AS v0,
         (1 - w) * CAST(@AT(e, (p + 21) % 64) AS DOUBLE) + w * CAST(@AT(f, (p + 21) % 64) AS DOUBLE) AS v1,
         (1 - w) * CAST(@AT(e, (p + 42) % 64) AS DOUBLE) + w * CAST(@AT(f, (p + 42) % 64) AS DOUBLE) AS v2
  FROM ab CROSS JOIN range(64) t(p)),
q AS (
  SELECT vec_id, domain, p,
         CAST(floor(least(255, greatest(0, (v0 + 0.6) / 1.2 * 255)) + 0.5) AS INT) AS r0,
         CAST(floor(least(255, greatest(0, (v1 + 0.6) / 1.2 * 255)) + 0.5) AS INT) AS g0,
         CAST(floor(least(255, greatest(0, (v2 + 0.6) / 1.2 * 255)) + 0.5) AS INT) AS b0
  FROM v)
SELECT vec_id, domain, CAST(floor(p / 8) AS INT) AS y, p % 8 AS x,
       CASE WHEN vec_id % 10 = 9 THEN 255 - CAST(floor((255 - r0) / 8) AS INT) ELSE r0 END AS r,
       CASE WHEN vec_id % 10 = 9 THEN 255 - CAST(floor((255 - g0) / 8) AS INT) ELSE g0 END AS g,
       CASE WHEN vec_id % 10 = 9 THEN 255 - CAST(floor((255 - b0) / 8) AS INT) ELSE b0 END AS b
FROM q"""

#: The vectors that a tile's pixels are mixed from, as in PIXELS.
MIXED = """
WITH n AS (SELECT count(*) AS n FROM embeddings)
SELECT a.vec_id, 'A' AS domain, a.embedding AS e, a.embedding AS f, 0.0D AS w FROM embeddings a
UNION ALL
SELECT a.vec_id, 'B' AS domain, a.embedding AS e, b.embedding AS f, 0.25D AS w
FROM embeddings a CROSS JOIN n JOIN embeddings b ON b.vec_id = (a.vec_id + 1) % n.n WHERE a.vec_id % 17 <> 16"""


def _bytes(vec_id: pa.Array, e: pa.Array, f: pa.Array, w: pa.Array) -> pa.Array:
    x, y = (a.values.to_numpy(zero_copy_only=False).astype(float).reshape(-1, 64) for a in (e, f))
    share = w.to_numpy(zero_copy_only=False)[:, None]
    v = np.floor(np.clip(((1 - share) * x + share * y + 0.6) / 1.2 * 255, 0, 255) + 0.5).astype(int)
    v = np.where((vec_id.to_numpy(zero_copy_only=False) % 10 == 9)[:, None], 255 - (255 - v) // 8, v)
    pixels = np.stack([v, np.roll(v, -21, 1), np.roll(v, -42, 1)], 2).astype(np.uint8)
    return pa.array([p.tobytes() for p in pixels], pa.binary())


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, domain, h, w, rgb: the tiles of PIXELS as bytes."""
    spark.read.parquet(f"{sf_dir}/embeddings.parquet").createOrReplaceTempView("embeddings")
    ready(spark)
    rgb = F.arrow_udf(_bytes, "binary").asNondeterministic()("vec_id", "e", "f", "w")
    return spark.sql(MIXED).select("vec_id", "domain", F.lit(8).alias("h"), F.lit(8).alias("w"), rgb.alias("rgb"))


def big_images(spark: SparkSession, sf_dir: str, tiles: int) -> DataFrame:
    """marker, domain, stem, name, h, w, rgb: `tiles` square tiles a domain from `lineitem`, as large as its rows allow, written down; B's colours are mixed from A's.

    A tile's pixels are sorted by Spark and pass through its task in Arrow batches, so only the bytes of one tile are held.
    """
    colour = "(1 + (l_partkey * 7) % 200) * 65536 + (1 + (l_suppkey * 13 + l_partkey) % 200) * 256 + 1 + (CAST(l_quantity AS INT) * 3 + l_partkey) % 200"
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(f"CAST(l_orderkey % {tiles} AS INT) AS tile", "l_orderkey", "l_linenumber", f"CAST({colour} AS INT) AS rgb")
    side = int((rows.groupBy("tile").count().agg(F.min("count")).first()[0] or 0) ** 0.5)

    def both(tile: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        v = np.concatenate(parts)
        mixed = np.empty_like(v)
        for i in range(3):
            mixed[:, i] = (3 * v[:, i].astype(np.int16) + v[:, i - 1]) // 4
        return pa.RecordBatch.from_arrays([pa.array([tile] * 2, pa.int32()), pa.array(["A", "B"]), pa.array([v.tobytes(), mixed.tobytes()], pa.binary())], names=["tile", "domain", "rgb"])

    def pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, room = None, [], 0
        for batch in batches:
            tile, rgb = (c.to_numpy() for c in batch.columns)
            starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(tile)), bool), tile[1:] != tile[:-1]]))
            for lo, hi in zip(starts, [*starts[1:], len(tile)], strict=True):
                if tile[lo] != at:
                    if parts:
                        yield both(at, parts)
                    at, parts, room = int(tile[lo]), [], side * side
                c = rgb[lo : min(hi, lo + room)]
                room -= len(c)
                parts.append(np.stack([c >> 16, c >> 8 & 255, c & 255], 1).astype(np.uint8))
        if parts:
            yield both(at, parts)

    ready(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = rows.repartition(n, "tile").sortWithinPartitions("tile", "l_orderkey", "l_linenumber", "rgb").select("tile", "rgb")
    made = order.mapInArrow(pixels, "tile int, domain string, rgb binary")
    stem = F.format_string("s%06d_r%dc%d", F.expr("tile div 4"), F.expr("tile % 4 div 2"), F.expr("tile % 2"))
    return stored(made.select(F.lit("ER").alias("marker"), "domain", stem.alias("stem"), F.concat(stem, F.lit(".png")).alias("name"), F.lit(side).alias("h"), F.lit(side).alias("w"), "rgb"), wide=True)


#: Source images of 16 x 16 pixels: the four tiles of a slide, where all are there.
SOURCES = """
SELECT t.slide, t.marker, t.domain, 16 AS h, 16 AS w,
       unhex(array_join(transform(sequence(0, 15), y -> concat(
         substr(max(CASE WHEN grid_row = 0 AND grid_col = 0 THEN hex(i.rgb) END), 1 + 48 * y, CASE WHEN y < 8 THEN 48 ELSE 0 END),
         substr(max(CASE WHEN grid_row = 0 AND grid_col = 1 THEN hex(i.rgb) END), 1 + 48 * y, CASE WHEN y < 8 THEN 48 ELSE 0 END),
         CASE WHEN y >= 8 THEN substr(max(CASE WHEN grid_row = 1 AND grid_col = 0 THEN hex(i.rgb) END), 1 + 48 * (y - 8), 48) ELSE '' END,
         CASE WHEN y >= 8 THEN substr(max(CASE WHEN grid_row = 1 AND grid_col = 1 THEN hex(i.rgb) END), 1 + 48 * (y - 8), 48) ELSE '' END)), '')) AS rgb
FROM tiles t JOIN images i USING (vec_id, domain) GROUP BY t.slide, t.marker, t.domain HAVING count(*) = 4"""

SCORES = """
SELECT marker, vectors, control, slice, field_a, field_b, downsample, dims, projection, 'sum' AS field_combine,
       CAST(24 * CASE field_a WHEN 'gray' THEN 0 WHEN 'hematoxylin/eosin' THEN 1 ELSE 2 END + 2 * (downsample - 1) + CASE dims WHEN '0,1' THEN 0 ELSE 1 END AS INT) AS combo_no,
       round(0.48 + 1.6 * avg(discount) + avg(tax), 2) AS auroc, count(*) AS n_tiles
FROM (SELECT CASE l_suppkey % 3 WHEN 0 THEN 'ER' WHEN 1 THEN 'Ki67' ELSE 'PR' END AS marker,
       CASE l_linestatus WHEN 'F' THEN 'fixed' ELSE 'estimated' END AS vectors,
       CASE l_linenumber % 2 WHEN 0 THEN 'strict' ELSE 'unstratified' END AS control,
       CASE WHEN l_quantity <= 25 THEN 1 ELSE 2 END AS slice,
       CASE l_partkey % 3 WHEN 0 THEN 'gray' WHEN 1 THEN 'hematoxylin/eosin' ELSE 'eosin/hematoxylin' END AS field_a,
       'dab+hematoxylin' AS field_b, CAST(1 + l_orderkey % 4 AS INT) AS downsample,
       CASE l_orderkey % 2 WHEN 0 THEN '0' ELSE '0,1' END AS dims, 'auto' AS projection,
       CAST(l_discount AS DOUBLE) AS discount, CAST(l_tax AS DOUBLE) AS tax FROM lineitem) q
GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9"""

BY_NAME = {"tiles": TILES, "pixels": PIXELS, "sources": SOURCES, "scores": SCORES}


def _engine(sql: str, duck: bool) -> str:
    if duck:
        return re.sub(r"@AT\((\w+), ([^@]*?)\) AS DOUBLE", r"list_extract(\1, \2 + 1) AS DOUBLE", sql)
    return re.sub(r"@AT\((\w+), ([^@]*?)\) AS DOUBLE", r"get(\1, CAST(\2 AS INT)) AS DOUBLE", sql)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = "lineitem" if name == "scores" else "embeddings"
    if name == "sources":
        fixture(spark, sf_dir, "tiles").createOrReplaceTempView("tiles")
        images(spark, sf_dir).createOrReplaceTempView("images")
    spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(_engine(BY_NAME[name], False))


def duck(body: str, *names: str, before: str = "") -> str:
    """body for DuckDB, with the named fixtures as common table expressions."""
    parts = [f"{n} AS ({_engine(BY_NAME[n], True)})" for n in names] + ([before] if before else [])
    return f"WITH {', '.join(parts)} {body}" if parts else body
