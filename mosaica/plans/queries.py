"""The registered queries of the tile operators, each beside the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaica.functions import optics
from mosaica.operators import pairing, persistence, registration, reports, scoring, stains, sweep, tiling
from mosaica.plans import jobs
from mosaica.sources import fixtures, images
from mosaica.sources.fixtures import duck, fixture
from mosaica.sources.scratch import shared_dir, stored

KEY = ["vec_id", "domain"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
H, E, D = (optics.unit(optics.STAINS[k]) for k in ("hematoxylin", "eosin", "dab"))


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return put


def r6(c):
    return F.round(c, 6)


def pixels(spark, d):
    return fixture(spark, d, "pixels")


def tiles(spark, d):
    return fixture(spark, d, "tiles").withColumn("name", F.concat("stem", F.lit(".png")))


def tile_images(spark, d):
    """marker, domain, slide, stem, name, vec_id, h, w, rgb of every tile."""
    return tiles(spark, d).join(fixtures.images(spark, d), KEY)


# ---- pixels and tiles

ODF = "-log10(least(1.0, greatest(0.001, CAST({} AS DOUBLE) / 255.0)))"
ODE = "greatest(0.0, -log10(greatest({}, 1) / 255.0))"


def dot(v) -> str:
    return " + ".join(f"{ODF.format(c)} * {x!r}" for c, x in zip("rgb", v, strict=True))


def conc(a, b) -> str:
    c = sum(x * y for x, y in zip(a, b, strict=True))
    return f"((({dot(a)}) - {c!r} * ({dot(b)})) / {1 - c * c!r})"


@query("p01_grid_crops", duck("""SELECT s.slide, t.o AS overlap, i.row AS grid_row, j.col AS grid_col, i.row * (8 - t.o) AS top, j.col * (8 - t.o) AS "left"
  FROM (SELECT slide FROM tiles WHERE domain = 'A' GROUP BY slide HAVING count(*) = 4) s CROSS JOIN (VALUES (0), (4)) t(o)
  CROSS JOIN range(9) i(row) CROSS JOIN range(9) j(col) WHERE i.row * (8 - t.o) + 8 <= 16 AND j.col * (8 - t.o) + 8 <= 16""", "tiles"))
def p01(spark, d):
    src = tiles(spark, d).where("domain = 'A'").groupBy("slide").count().where("count = 4").select("slide", F.lit(16).alias("h"), F.lit(16).alias("w"))
    both = [tiling.crop_grid(src, 8, o).select("slide", F.lit(o).alias("overlap"), "grid_row", "grid_col", "top", "left") for o in (0, 4)]
    return both[0].unionByName(both[1])


@query("p02_crop_estimate", duck("""SELECT marker AS split, count(*) AS n_images, count(*) * (greatest(0, arg_min(h, slide) - 8) // 8 + 1) * (greatest(0, arg_min(w, slide) - 8) // 8 + 1) AS crops,
  CAST(arg_min(h, slide) % 8 + arg_min(w, slide) % 8 AS INT) AS edge, 2.0 AS scale FROM
  (SELECT marker, slide, CAST(9 + CAST(substr(slide, 2) AS INT) * 7 % 40 AS INT) AS h, CAST(9 + CAST(substr(slide, 2) AS INT) * 5 % 30 AS INT) AS w FROM tiles WHERE domain = 'A' GROUP BY marker, slide) GROUP BY marker""", "tiles"))
def p02(spark, d):
    """Images of many sizes: the first by name counts."""
    src = tiles(spark, d).where("domain = 'A'").select(F.col("marker").alias("split"), F.col("slide").alias("name")).distinct()
    number = F.expr("CAST(substr(name, 2) AS INT)")
    return tiling.crop_estimate(src.select("split", "name", (9 + number * 7 % 40).alias("h"), (9 + number * 5 % 30).alias("w")), 8, 4)


@query("p03_p04_tissue", duck("""SELECT vec_id, domain, avg(CASE WHEN ((r * 19595 + g * 38470 + b * 7471 + 32768) >> 16) < 220 THEN 1.0 ELSE 0.0 END) AS tissue
  FROM px GROUP BY 1, 2 HAVING avg(CASE WHEN ((r * 19595 + g * 38470 + b * 7471 + 32768) >> 16) < 220 THEN 1.0 ELSE 0.0 END) >= 0.5""", "pixels", before="px AS (SELECT * FROM pixels)"))
def p03(spark, d):
    return tiling.tissue(fixtures.images(spark, d)).where("tissue >= 0.5").select(*KEY, "tissue")


@query("p07_downsample", duck("""SELECT vec_id, domain, y // 3 AS y, x // 3 AS x, round(avg(r), 6) AS r, round(avg(g), 6) AS g, round(avg(b), 6) AS b
  FROM pixels WHERE y < 6 AND x < 6 GROUP BY ALL""", "pixels"))
def p07(spark, d):
    got = tiling.downsampled(fixtures.images(spark, d), 3).select(*KEY, F.expr("w div 3").alias("_w"), F.posexplode(F.arrays_zip(*[F.col("pooled")[i].alias(c) for i, c in enumerate("rgb")])).alias("p", "v"))
    return got.select(*KEY, F.expr("p div _w").alias("y"), F.expr("CAST(p % _w AS BIGINT)").alias("x"), *[r6(F.col("v")[c]).alias(c) for c in "rgb"])


@query("p05_lanczos", duck("""WITH_ SELECT vec_id, domain, CAST(i AS INT) AS y, CAST(j AS INT) AS x, CAST(least(255.0, greatest(0.0, round_even(sum(a.w * b.w * r), 0))) AS INT) AS r,
  CAST(least(255.0, greatest(0.0, round_even(sum(a.w * b.w * g), 0))) AS INT) AS g, CAST(least(255.0, greatest(0.0, round_even(sum(a.w * b.w * b_), 0))) AS INT) AS b FROM (SELECT vec_id, domain, y, x, r, g, b AS b_ FROM pixels)
  JOIN k a ON a.n = y JOIN (SELECT i AS j, n AS m, w FROM k) b ON b.m = x GROUP BY ALL""".replace("WITH_ ", ""), "pixels", before="""raw AS (SELECT i, n, ((n + 0.5) - (i + 0.5) * 8 / 5.0) / 1.6 AS t FROM range(5) a(i) CROSS JOIN range(8) b(n)),
  kk AS (SELECT i, n, CASE WHEN abs(t) >= 3 THEN 0.0 WHEN t = 0 THEN 1.0 ELSE sin(pi() * t) / (pi() * t) * sin(pi() * t / 3) / (pi() * t / 3) END AS w FROM raw),
  k AS (SELECT i, n, w / sum(w) OVER (PARTITION BY i) AS w FROM kk)"""))
def p05(spark, d):
    small = tiling.resized(fixtures.images(spark, d), 5)
    level = lambda p, c: F.conv(F.hex(F.substring("rgb", 3 * p + 1 + c, 1)), 16, 10).cast("int")
    at = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(24)), lambda p: F.struct(*[level(p, i).alias(c) for i, c in enumerate("rgb")]))).alias("p", "v")
    return small.select(*KEY, at).select(*KEY, F.expr("p div 5").cast("int").alias("y"), F.expr("p % 5").alias("x"), "v.*")


@query("p06_loaded", duck("SELECT vec_id, domain, round(sum((r / 127.5 - 1) * (1 + y * 8 + x) + (g / 127.5 - 1) * (65 + y * 8 + x) + (b / 127.5 - 1) * (129 + y * 8 + x)), 4) AS s FROM pixels GROUP BY ALL", "pixels"))
def p06(spark, d):
    got = tiling.loaded(fixtures.images(spark, d), 8)
    weighted = F.aggregate(F.transform("x", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return got.select(*KEY, F.round(weighted, 4).alias("s"))


@query("p08_p10_densities", duck(f"""SELECT vec_id, domain, round(sum({ODE.format('r')}), 6) AS od_est, round(sum({ODF.format('g')}), 6) AS od_field,
  round(sum((0.299 * r + 0.587 * g + 0.114 * b) / 255.0), 6) AS gray FROM pixels GROUP BY ALL""", "pixels"))
def p08(spark, d):
    return pixels(spark, d).groupBy(*KEY).agg(r6(F.sum(optics.od_estimation(F.col("r")))).alias("od_est"), r6(F.sum(optics.od_field(F.col("g")))).alias("od_field"), r6(F.sum(optics.gray())).alias("gray"))


@query("p11_p16_fields", duck(f"""SELECT vec_id, domain, round(avg({dot(H)}), 6) AS bare, round(avg({conc(H, E)}), 6) AS h_of_e, round(avg(greatest({conc(D, H)}, {conc(H, D)})), 6) AS merged_max,
  round(avg({conc(D, H)} + {conc(H, D)}), 6) AS merged_sum, round(avg(({conc(D, H)} + {conc(H, D)}) / 2), 6) AS merged_mean, round(min(-({conc(H, E)})), 6) AS inverted_min
  FROM pixels GROUP BY ALL""", "pixels"))
def p11(spark, d):
    f = optics.field
    cols = {"bare": f("hematoxylin"), "h_of_e": f("hematoxylin/eosin"), "merged_max": f("dab+hematoxylin"), "merged_sum": f("dab+hematoxylin", "sum"), "merged_mean": f("dab+hematoxylin", "mean")}
    return pixels(spark, d).groupBy(*KEY).agg(*[r6(F.avg(v)).alias(k) for k, v in cols.items()], r6(F.min(-f("hematoxylin/eosin"))).alias("inverted_min"))


@query("p15_split_channels", duck(f"SELECT vec_id, domain, round(max({conc(D, H)}), 6) AS first, round(max({conc(H, D)}), 6) AS second FROM pixels GROUP BY ALL", "pixels"))
def p15(spark, d):
    a, b = optics.split_specs("dab+hematoxylin")
    return pixels(spark, d).groupBy(*KEY).agg(r6(F.max(optics.field(a))).alias("first"), r6(F.max(optics.field(b))).alias("second"))


@query("p17_rendered", duck(f"""SELECT vec_id, domain, sum(CAST(least(255.0, greatest(0.0, round_even(255.0 * pow(10.0, -greatest({conc(H, E)}, 0.0)), 0))) AS INT)) AS level FROM pixels GROUP BY ALL""", "pixels"))
def p17(spark, d):
    return pixels(spark, d).groupBy(*KEY).agg(F.sum(optics.rendered(optics.field("hematoxylin/eosin"))).alias("level"))


@query("p18_stretch", duck("""SELECT vec_id, domain, round(avg(least(1.0, greatest(0.0, (v - lo) / (CASE WHEN hi <= lo THEN 0.000001 ELSE hi - lo END)))), 5) AS level FROM
  (SELECT vec_id, domain, (0.299 * r + 0.587 * g + 0.114 * b) / 255.0 AS v FROM pixels) JOIN
  (SELECT vec_id, domain, quantile_cont((0.299 * r + 0.587 * g + 0.114 * b) / 255.0, 0.005) AS lo, quantile_cont((0.299 * r + 0.587 * g + 0.114 * b) / 255.0, 0.995) AS hi FROM pixels GROUP BY ALL)
  USING (vec_id, domain) GROUP BY ALL""", "pixels"))
def p18(spark, d):
    got = tiling.stretched(fixtures.images(spark, d))
    return got.select(*KEY, F.round(F.aggregate("levels", F.lit(0.0), lambda s, x: s + x) / F.size("levels"), 5).alias("level"))


@query("p19_slides", duck("SELECT marker, regexp_replace(stem, '_r\\d+c\\d+$', '') AS slide, count(*) AS n FROM tiles GROUP BY ALL", "tiles"))
def p19(spark, d):
    return tiles(spark, d).groupBy("marker", pairing.slide_of("stem").alias("slide")).agg(F.count(F.lit(1)).alias("n"))


# ---- registration of cases

CASES = """cases AS (SELECT 'A' AS domain, concat('c', CAST(vec_id // 20 AS VARCHAR)) AS case_id, CAST(vec_id % 20 AS VARCHAR) AS id, CAST(512 * (vec_id % 4) AS VARCHAR) AS x, CAST(512 * ((vec_id % 20) // 4) AS VARCHAR) AS y FROM embeddings
  UNION ALL SELECT 'B', concat('c', CAST(vec_id // 20 AS VARCHAR)), CAST(vec_id % 20 + 1 AS VARCHAR), CASE WHEN vec_id = 67 THEN 'n/a' ELSE CAST(512 * (vec_id % 4) AS VARCHAR) END, CAST(512 * ((vec_id % 20) // 4) AS VARCHAR) FROM embeddings WHERE vec_id % 17 <> 16),
 good AS (SELECT domain, case_id FROM cases GROUP BY ALL HAVING bool_and(try_cast(x AS INT) IS NOT NULL AND try_cast(y AS INT) IS NOT NULL)),
 both_good AS (SELECT case_id FROM good GROUP BY ALL HAVING count(*) = 2),
 pairs AS (SELECT a.case_id, a.id AS id_a, b.id AS id_b, 'coordinate' AS how, concat(a.case_id, '_', CAST(CAST(a.y AS INT) // 512 // 2 AS VARCHAR), '_', CAST(CAST(a.x AS INT) // 512 // 2 AS VARCHAR), '_r', CAST(CAST(a.y AS INT) // 512 % 2 AS VARCHAR), 'c', CAST(CAST(a.x AS INT) // 512 % 2 AS VARCHAR)) AS name
   FROM cases a JOIN cases b ON a.domain = 'A' AND b.domain = 'B' AND a.case_id = b.case_id AND a.x = b.x AND a.y = b.y WHERE a.case_id IN (SELECT case_id FROM both_good)
   UNION ALL SELECT a.case_id, a.id, b.id, 'id', concat(a.case_id, '_', a.id) FROM cases a JOIN cases b ON a.domain = 'A' AND b.domain = 'B' AND a.case_id = b.case_id AND a.id = b.id WHERE a.case_id NOT IN (SELECT case_id FROM both_good))"""


def cases(spark, d):
    spark.read.parquet(f"{d}/embeddings.parquet").createOrReplaceTempView("embeddings")
    return spark.sql("""SELECT 'A' AS domain, concat('c', CAST(vec_id div 20 AS STRING)) AS case_id, CAST(vec_id % 20 AS STRING) AS id, CAST(512 * (vec_id % 4) AS STRING) AS x, CAST(512 * ((vec_id % 20) div 4) AS STRING) AS y FROM embeddings
      UNION ALL SELECT 'B', concat('c', CAST(vec_id div 20 AS STRING)), CAST(vec_id % 20 + 1 AS STRING), CASE WHEN vec_id = 67 THEN 'n/a' ELSE CAST(512 * (vec_id % 4) AS STRING) END, CAST(512 * ((vec_id % 20) div 4) AS STRING) FROM embeddings WHERE vec_id % 17 <> 16""")


@query("s05_valid_metadata", duck("SELECT * FROM good", before=CASES))
def s05(spark, d):
    return registration.valid_cases(cases(spark, d))


@query("j03_j04_p20_registered", duck("SELECT * FROM pairs", before=CASES))
def j03(spark, d):
    return registration.registered_pairs(cases(spark, d), 512)


#: Images that are there: all but every 13th; B places no tile of every fourth case, and of the others one place twice.
INDEXED = CASES.split(",\n good AS")[0] + """,
 there AS (SELECT * FROM cases WHERE hash_of(case_id, id) % 13 <> 5),
 placed AS (SELECT *, CAST(x AS INT) AS xi, CAST(y AS INT) AS yi FROM cases WHERE case_id NOT IN (SELECT case_id FROM cases WHERE x = 'n/a') AND NOT (domain = 'B' AND num_of(case_id) % 4 = 1)),
 pa AS (SELECT * FROM placed WHERE domain = 'A'), pb AS (SELECT case_id, xi, yi, id FROM placed WHERE domain = 'B' AND id <> '7' UNION ALL SELECT case_id, 1536, 0, id FROM placed WHERE domain = 'B' AND id = '7'),
 lastb AS (SELECT case_id, xi, yi, arg_max(id, CAST(id AS INT)) AS id FROM pb GROUP BY ALL),
 bycoord AS (SELECT a.case_id, a.id AS id_a, b.id AS id_b, 'coordinate' AS how, concat(a.case_id, '_', CAST(a.yi // 512 // 2 AS VARCHAR), '_', CAST(a.xi // 512 // 2 AS VARCHAR), '_r', CAST(a.yi // 512 % 2 AS VARCHAR), 'c', CAST(a.xi // 512 % 2 AS VARCHAR)) AS name FROM pa a JOIN lastb b USING (case_id, xi, yi)),
 byid AS (SELECT a.case_id, a.id AS id_a, b.id AS id_b, 'id' AS how, concat(a.case_id, '_', a.id) AS name FROM there a JOIN there b ON a.domain = 'A' AND b.domain = 'B' AND a.case_id = b.case_id AND a.id = b.id WHERE a.case_id NOT IN (SELECT case_id FROM pb)),
 found AS (SELECT * FROM (SELECT * FROM bycoord UNION ALL SELECT * FROM byid) p WHERE EXISTS (SELECT 1 FROM there t WHERE t.domain = 'A' AND t.case_id = p.case_id AND t.id = p.id_a) AND EXISTS (SELECT 1 FROM there t WHERE t.domain = 'B' AND t.case_id = p.case_id AND t.id = p.id_b))"""
INDEXED = INDEXED.replace("hash_of(case_id, id)", "(CAST(substr(case_id, 2) AS INT) * 7 + CAST(id AS INT))").replace("num_of(case_id)", "CAST(substr(case_id, 2) AS INT)")


@query("j03_j04_indexed_places", duck("SELECT * FROM found", before=INDEXED))
def j03_indexed(spark, d):
    """Pairs by the files that place tiles and the images that are there: both sides of registered_pairs()."""
    c = cases(spark, d)
    number = "CAST(substr(case_id, 2) AS INT)"
    there = c.where(f"({number} * 7 + CAST(id AS INT)) % 13 <> 5").select("domain", "case_id", "id")
    bad = c.where("x = 'n/a'").select("case_id")
    placed = c.join(bad, "case_id", "left_anti").where(f"NOT (domain = 'B' AND {number} % 4 = 1)")
    twice = (F.col("domain") == "B") & (F.col("id") == "7")
    placed = placed.select("domain", "case_id", "id", *[F.when(twice, v).otherwise(F.col(k).cast("long")).alias(k) for k, v in (("x", 1536), ("y", 0))], F.lit(512).cast("long").alias("tile_size"), F.col("id").cast("int").alias("line"))
    shared = there.groupBy("case_id").agg(F.countDistinct("domain").alias("n")).where("n = 2").select("case_id")
    meta = registration.located(placed, there).join(shared, "case_id", "left_semi")
    return registration.registered_pairs(meta, "tile_size", there, "line")


@query("a09_registration_report", duck("""SELECT c.case_id, c.tiles_a, c.tiles_b, coalesce(p.paired, 0) AS paired, round(p.agree, 6) AS id_agreement FROM
  (SELECT case_id, count(*) FILTER (WHERE domain = 'A') AS tiles_a, count(*) FILTER (WHERE domain = 'B') AS tiles_b FROM cases GROUP BY ALL) c
  LEFT JOIN (SELECT case_id, count(*) AS paired, avg(CASE WHEN id_a = id_b THEN 1.0 ELSE 0.0 END) AS agree FROM pairs GROUP BY ALL) p USING (case_id) WHERE tiles_a > 0 AND tiles_b > 0""", before=CASES))
def a09(spark, d):
    return registration.report(cases(spark, d), registration.registered_pairs(cases(spark, d), 512)).withColumn("id_agreement", r6("id_agreement"))


@query("u01_j09_candidates", duck("""SELECT domain, case_id, id FROM cases WHERE case_id NOT IN (SELECT case_id FROM cases WHERE CAST(substr(case_id, 2) AS INT) % 5 = 0)
  UNION SELECT 'A', case_id, id_a FROM pairs UNION SELECT 'B', case_id, id_b FROM pairs""", before=CASES))
def u01(spark, d):
    c = cases(spark, d)
    held = c.where("CAST(substr(case_id, 2) AS INT) % 5 = 0").select("case_id").distinct()
    return registration.candidates(c, registration.registered_pairs(c, 512), held)


@query("u02_u03_shared_cases", duck("""SELECT case_id, CAST(substr(case_id, 2) AS INT) % 5 = 0 AS in_val FROM (SELECT case_id FROM cases WHERE domain = 'A' INTERSECT SELECT case_id FROM cases WHERE domain = 'B')""", before=CASES))
def u02(spark, d):
    c = cases(spark, d)
    shared = c.where("domain = 'A'").select("case_id").intersect(c.where("domain = 'B'").select("case_id"))
    return shared.withColumn("in_val", F.expr("CAST(substr(case_id, 2) AS INT) % 5 = 0"))


TISSUE = "t AS (SELECT vec_id, domain, avg(CASE WHEN ((r * 19595 + g * 38470 + b * 7471 + 32768) >> 16) < 220 THEN 1.0 ELSE 0.0 END) AS tissue FROM pixels GROUP BY ALL)"


UNDER = ", ".join(f"count(*) FILTER (WHERE tissue < {u}) AS under_{round(100 * u):02d}, count(*) FILTER (WHERE tissue < {u}) / count(*) AS share_{round(100 * u):02d}" for u in tiling.UNDER)


@query("a08_tissue_survey", duck(f"""SELECT domain, round(unnest(quantile_cont(tissue, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])), 6) AS decile, unnest(range(11)) AS k,
  {UNDER} FROM t GROUP BY domain""", "pixels", before=TISSUE))
def a08(spark, d):
    return tiling.survey(tiling.tissue(fixtures.images(spark, d)), ["domain"]).withColumn("decile", r6("decile"))


@query("j10_a22_pair_filter", duck("""SELECT m.marker, count(*) AS kept, count(*) // 2 AS per_slice, round(0.5 + 2.58 * sqrt(0.16667 / greatest(count(*) // 2, 1)), 6) AS bar
  FROM t a JOIN t b ON a.vec_id = b.vec_id AND a.domain = 'A' AND b.domain = 'B' JOIN tiles m ON m.vec_id = a.vec_id AND m.domain = 'A' WHERE least(a.tissue, b.tissue) >= 0.5 GROUP BY m.marker""", "pixels", "tiles", before=TISSUE))
def j10(spark, d):
    t = tiling.tissue(tile_images(spark, d)).select("domain", F.col("marker").alias("case_id"), F.col("vec_id").alias("id"), "tissue")
    a, b = (t.where(f"domain = '{x.upper()}'").select("case_id", "id", F.col("id").alias(f"id_{x}")) for x in "ab")
    kept = registration.with_tissue(a.join(b, ["case_id", "id"]), t, 0.5).withColumnRenamed("case_id", "marker")
    return registration.power(kept, ["marker"]).withColumn("bar", r6("bar"))


@query("j10_training_filter", duck("""SELECT m.marker AS case_id, t.domain, count(*) AS tiles FROM t JOIN tiles m USING (vec_id, domain) WHERE tissue >= 0.5 AND m.marker <> 'PR' GROUP BY ALL""", "pixels", "tiles", before=TISSUE))
def j10_training(spark, d):
    """Training tiles: each side alone, without a held-out case."""
    t = stored(tiling.tissue(tile_images(spark, d)).select("domain", F.col("marker").alias("case_id"), F.col("vec_id").alias("id"), "tissue"))
    held = t.where("case_id = 'PR'").select("case_id")
    return registration.training_tiles(t.drop("tissue"), t, held, 0.5).groupBy("case_id", "domain").agg(F.count(F.lit(1)).alias("tiles"))


# ---- pairs, partners, splits

PAIRS = """tp AS (SELECT a.marker, a.stem, a.slide, row_number() OVER (PARTITION BY a.marker ORDER BY md5(concat('7:', a.stem)), a.stem) - 1 AS pair_idx
  FROM tiles a JOIN tiles b ON a.marker = b.marker AND a.stem = b.stem AND a.domain = 'A' AND b.domain = 'B')"""


def pairs(spark, d):
    return pairing.sampled(pairing.matched_pairs(tiles(spark, d)), 7).withColumn("slide", pairing.slide_of("stem"))


@query("j01_w01_pairs", duck("SELECT marker, pair_idx, stem, concat(stem, '.png') AS a, concat(stem, '.png') AS b, slide FROM tp", "tiles", before=PAIRS))
def j01(spark, d):
    return pairs(spark, d).select("marker", "pair_idx", "stem", "a", "b", "slide")


@query("j02_order_pairs", duck("""SELECT a.marker, a.name AS a, b.name AS b, 'order' AS how FROM (SELECT *, concat(stem, '.png') AS name, row_number() OVER (PARTITION BY marker ORDER BY stem) AS n FROM tiles WHERE domain = 'A') a
  JOIN (SELECT *, concat('z', stem, '.png') AS name, row_number() OVER (PARTITION BY marker ORDER BY stem) AS n FROM tiles WHERE domain = 'B') b USING (marker, n)""", "tiles"))
def j02(spark, d):
    t = tiles(spark, d)
    b = t.where("domain = 'B'").withColumns({"stem": F.concat(F.lit("z"), "stem"), "name": F.concat(F.lit("z"), "name")})
    return pairing.matched_pairs(t.where("domain = 'A'").unionByName(b)).select("marker", "a", "b", "how")


@query("w02_slices", duck("SELECT marker, pair_idx >= n // 2 AS second, count(*) AS pairs, min(pair_idx) AS first_idx FROM (SELECT *, count(*) OVER (PARTITION BY marker) AS n FROM tp) WHERE pair_idx < 2 * (n // 2) GROUP BY ALL", "tiles", before=PAIRS))
def w02(spark, d):
    p = pairing.halves(pairs(spark, d)).where("pair_idx < 2 * half")
    return p.groupBy("marker", (F.col("pair_idx") >= F.col("half")).alias("second")).agg(F.count(F.lit(1)).alias("pairs"), F.min("pair_idx").alias("first_idx"))


@query("w03_usable", duck("SELECT marker, count(DISTINCT slide) AS groups, count(*) FILTER (WHERE n > 1) AS usable, count(*) FILTER (WHERE n = 1) AS excluded FROM (SELECT *, count(*) OVER (PARTITION BY marker, slide) AS n FROM tp) GROUP BY marker", "tiles", before=PAIRS))
def w03(spark, d):
    n = pairs(spark, d).groupBy("marker", "slide").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("marker").agg(F.count(F.lit(1)).alias("groups"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("usable"), F.count_if(F.col("n") == 1).alias("excluded"))


@query("j05_strict_partners", duck("""SELECT marker, shuffle_no, a.pair_idx, b.pair_idx AS partner_idx FROM
  (SELECT *, row_number() OVER (PARTITION BY marker, slide ORDER BY pair_idx) - 1 AS rn, count(*) OVER (PARTITION BY marker, slide) AS n FROM tp) a CROSS JOIN range(3) s(shuffle_no)
  JOIN (SELECT marker, slide, pair_idx, row_number() OVER (PARTITION BY marker, slide ORDER BY pair_idx) - 1 AS rn FROM tp) b USING (marker, slide)
  WHERE n > 1 AND b.rn = (a.rn + 1 + CAST(concat('0x', substr(md5(concat('7:', slide, ':', CAST(shuffle_no AS VARCHAR))), 1, 8)) AS BIGINT) % (n - 1)) % n""", "tiles", before=PAIRS))
def j05(spark, d):
    return pairing.strict_partners(pairs(spark, d), 7, 3)


@query("j08_counted_pairs", duck("""SELECT marker, pair_idx, partner_idx, CAST(sum(t) AS BIGINT) AS true_pairs, CAST(sum(w) AS BIGINT) AS wrong_pairs FROM
  (SELECT a.marker, a.pair_idx, b.pair_idx AS partner_idx, 0 AS t, 1 AS w FROM
   (SELECT *, row_number() OVER (PARTITION BY marker, slide ORDER BY pair_idx) - 1 AS rn, count(*) OVER (PARTITION BY marker, slide) AS n FROM tp) a CROSS JOIN range(10) s(shuffle_no)
   JOIN (SELECT marker, slide, pair_idx, row_number() OVER (PARTITION BY marker, slide ORDER BY pair_idx) - 1 AS rn FROM tp) b ON a.marker = b.marker AND a.slide = b.slide
   WHERE n > 1 AND b.rn = (a.rn + 1 + CAST(concat('0x', substr(md5(concat('7:', a.slide, ':', CAST(shuffle_no AS VARCHAR))), 1, 8)) AS BIGINT) % (n - 1)) % n
   UNION ALL SELECT marker, pair_idx, pair_idx, 1, 0 FROM (SELECT *, count(*) OVER (PARTITION BY marker, slide) AS n FROM tp) WHERE n > 1) GROUP BY ALL""", "tiles", before=PAIRS))
def j08_counted(spark, d):
    """What ten shuffles compare: each two tiles once, with how often they meet."""
    return sweep.counted_pairs(pairing.strict_partners(pairs(spark, d), 7, 10))


@query("j06_free_partners", duck("""SELECT marker, shuffle_no, pair_idx, coalesce(lead(pair_idx) OVER w, first(pair_idx) OVER (PARTITION BY marker, shuffle_no ORDER BY md5(concat('7:', CAST(pair_idx AS VARCHAR), ':', CAST(shuffle_no AS VARCHAR))), pair_idx)) AS partner_idx
  FROM tp CROSS JOIN range(3) s(shuffle_no) WINDOW w AS (PARTITION BY marker, shuffle_no ORDER BY md5(concat('7:', CAST(pair_idx AS VARCHAR), ':', CAST(shuffle_no AS VARCHAR))), pair_idx)""", "tiles", before=PAIRS))
def j06(spark, d):
    return pairing.free_partners(pairs(spark, d), 7, 3)


@query("j11_holdout", duck("""SELECT t.marker, t.domain, t.stem, CASE WHEN v.slide IS NULL THEN 'train' ELSE 'val' END AS split FROM tiles t LEFT JOIN
  (SELECT marker, slide FROM (SELECT marker, slide, row_number() OVER (PARTITION BY marker ORDER BY md5(concat('7:', slide)), slide) AS rn, count(*) OVER (PARTITION BY marker) AS n
   FROM (SELECT marker, slide FROM tiles GROUP BY ALL HAVING count(DISTINCT domain) = 2)) WHERE rn <= greatest(1, round_even(n * 0.1, 0))) v ON t.marker = v.marker AND t.slide = v.slide""", "tiles"))
def j11(spark, d):
    return pairing.holdout(tiles(spark, d), 0.1, 7).select("marker", "domain", "stem", "split")


@query("s10_incremental", duck("SELECT stem FROM (SELECT stem FROM tiles WHERE domain = 'A' AND vec_id % 3 <> 0) ORDER BY stem LIMIT 100", "tiles"))
def s10(spark, d):
    t = tiles(spark, d).where("domain = 'A'")
    return tiling.pending(t.select("stem"), t.where("vec_id % 3 = 0").select("stem"), "stem", 100)


@query("s06_split_counts", duck("SELECT marker, domain, count(*) FILTER (WHERE tissue >= 0.5) AS written, count(*) FILTER (WHERE tissue < 0.5) AS skipped FROM t JOIN tiles USING (vec_id, domain) GROUP BY ALL", "tiles", "pixels", before=TISSUE))
def s06(spark, d):
    t = tiling.tissue(tile_images(spark, d))
    return t.groupBy("marker", "domain").agg(F.count_if(F.col("tissue") >= 0.5).alias("written"), F.count_if(F.col("tissue") < 0.5).alias("skipped"))


CROPS = """src AS (SELECT s.slide, s.marker, s.domain FROM tiles s GROUP BY ALL HAVING count(*) = 4),
 wide AS (SELECT t.slide, t.marker, t.domain, t.grid_row * 8 + p.y AS y, t.grid_col * 8 + p.x AS x, CASE WHEN ((r * 19595 + g * 38470 + b * 7471 + 32768) >> 16) < 220 THEN 1.0 ELSE 0.0 END AS dark
   FROM tiles t JOIN pixels p USING (vec_id, domain) JOIN src s ON s.slide = t.slide AND s.domain = t.domain),
 crop AS (SELECT slide, marker, domain, i.row AS grid_row, j.col AS grid_col, avg(dark) AS tissue FROM wide JOIN range(3) i(row) ON y BETWEEN 4 * i.row AND 4 * i.row + 7 JOIN range(3) j(col) ON x BETWEEN 4 * j.col AND 4 * j.col + 7 GROUP BY ALL)"""


def ingested(spark, d):
    """Source images cut into overlapping tiles with tissue and written by marker, split and domain: the folder and the counts of each marker."""
    src = fixture(spark, d, "sources")
    src = src.select(F.concat("slide", F.lit("/"), "domain").alias("origin"), F.concat("slide", F.lit(".png")).alias("name"), "marker", "h", "w", "rgb", F.lit(True).alias("valid"), F.concat(F.lit("train"), "domain").alias("split"))
    out = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}/tiles-{uuid.uuid4().hex}"
    counts = [jobs.ingest_tiles(src.where(F.col("marker") == m), m, out, 8, overlap=4, tissue_threshold=0.5).withColumn("marker", F.lit(m)) for m in ("ER", "Ki67", "PR")]
    return out, reduce(DataFrame.unionByName, counts)


@query("s06_ingested_counts", duck("SELECT marker, concat('train', domain) AS split, count(DISTINCT slide) AS images, count(*) FILTER (WHERE tissue >= 0.5) AS written, count(*) FILTER (WHERE tissue < 0.5) AS skipped FROM crop GROUP BY ALL", "tiles", "pixels", before=CROPS))
def s06_counts(spark, d):
    return ingested(spark, d)[1]


@query("s06_ingested_tiles", duck("SELECT marker, 'train' AS split, domain, slide, concat(slide, '_r', CAST(grid_row AS VARCHAR), 'c', CAST(grid_col AS VARCHAR)) AS stem, round(tissue, 6) AS tissue FROM crop WHERE tissue >= 0.5", "tiles", "pixels", before=CROPS))
def s06_tiles(spark, d):
    got = spark.read.parquet(ingested(spark, d)[0])
    return tiling.tissue(got).select("marker", "split", "domain", "slide", "stem", r6("tissue").alias("tissue"))


# ---- stains

BIG = "px AS (SELECT l_orderkey % 16 AS tile, l_orderkey % 8 AS marker, CASE WHEN l_orderkey % 16 < 8 THEN 'A' ELSE 'B' END AS domain, 1 + (l_partkey * 7) % 200 AS r, 1 + (l_suppkey * 13 + l_partkey) % 200 AS g, 1 + (CAST(l_quantity AS INT) * 3 + l_partkey) % 200 AS b FROM lineitem)"


def big(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return li.selectExpr("l_orderkey % 16 AS tile", "1 + (l_partkey * 7) % 200 AS r", "1 + (l_suppkey * 13 + l_partkey) % 200 AS g", "1 + (CAST(l_quantity AS INT) * 3 + l_partkey) % 200 AS b")


OD3 = ", ".join(f"{ODE.format(c)} AS o{i}" for i, c in enumerate("rgb"))


@query("a03_a04_moments", duck(f"SELECT tile, count(*) AS n, {', '.join(f'round(avg(o{i} * o{j}), 6) AS m{i}{j}' for i in range(3) for j in range(i, 3))} FROM (SELECT tile, {OD3} FROM px) WHERE greatest(o0, o1, o2) BETWEEN 0.05 AND 1.0 GROUP BY tile", before=BIG))
def a03(spark, d):
    m = stains.moments(stains.stained(big(spark, d)), ["tile"])
    return m.select("tile", "n", *[r6(c).alias(c) for c in m.columns if c[0] == "m"])


def det(m: str) -> str:
    return f"({m}00 * ({m}11 * {m}22 - {m}12 * {m}12) - {m}01 * ({m}01 * {m}22 - {m}12 * {m}02) + {m}02 * ({m}01 * {m}12 - {m}11 * {m}02))"


def unit3(a: str, b: str, c: str, name: str) -> str:
    return ", ".join(f"{x} / sqrt({a} * {a} + {b} * {b} + {c} * {c}) AS {name}{i}" for i, x in enumerate((a, b, c)))


def dot3(a: str, b: str) -> str:
    return "(" + " + ".join(f"{a}{i} * {b}{i}" for i in range(3)) + ")"


def degrees3(a: str, b: str) -> str:
    return f"degrees(acos(least(1.0, greatest(-1.0, {dot3(a, b)}))))"


#: Eigenvalues in closed form, eigenvectors as cross products, percentiles of the angle, and the rules of order, of pixels px with a marker and a domain.
PLANE = f"""od AS (SELECT * FROM (SELECT marker, domain, {', '.join(f'{ODE.format(c)} AS o{i}' for i, c in enumerate('rgb'))} FROM px) WHERE greatest(o0, o1, o2) BETWEEN 0.05 AND 1.0),
 mo AS (SELECT marker, domain, count(*) AS n, {', '.join(f'avg(o{i} * o{j}) AS m{i}{j}' for i in range(3) for j in range(i, 3))} FROM od GROUP BY ALL),
 e0 AS (SELECT *, (m00 + m11 + m22) / 3 AS q FROM mo),
 e1 AS (SELECT *, sqrt(((m00 - q) * (m00 - q) + (m11 - q) * (m11 - q) + (m22 - q) * (m22 - q) + 2 * (m01 * m01 + m02 * m02 + m12 * m12)) / 6) AS p FROM e0),
 e2 AS (SELECT *, (m00 - q) / p AS b00, m01 / p AS b01, m02 / p AS b02, (m11 - q) / p AS b11, m12 / p AS b12, (m22 - q) / p AS b22 FROM e1),
 e3 AS (SELECT *, acos(least(1.0, greatest(-1.0, {det('b')} / 2))) / 3 AS f FROM e2),
 e4 AS (SELECT *, q + 2 * p * cos(f) AS l1, q + 2 * p * cos(f + 2 * pi() / 3) AS l3 FROM e3),
 e5 AS (SELECT *, 3 * q - l1 - l3 AS l2 FROM e4),
 e6 AS (SELECT *, m01 * m12 - m02 * (m11 - l1) AS u0, m02 * m01 - (m00 - l1) * m12 AS u1, (m00 - l1) * (m11 - l1) - m01 * m01 AS u2,
   m01 * m12 - m02 * (m11 - l2) AS w0, m02 * m01 - (m00 - l2) * m12 AS w1, (m00 - l2) * (m11 - l2) - m01 * m01 AS w2 FROM e5),
 e7 AS (SELECT marker, domain, n, {unit3('u0', 'u1', 'u2', 'x')}, {unit3('w0', 'w1', 'w2', 'y')} FROM e6),
 e8 AS (SELECT marker, domain, n, {', '.join(f'CASE WHEN x0 + x1 + x2 < 0 THEN -x{i} ELSE x{i} END AS x{i}, CASE WHEN y0 + y1 + y2 < 0 THEN -y{i} ELSE y{i} END AS y{i}' for i in range(3))} FROM e7),
 ph AS (SELECT marker, domain, quantile_cont(phi, 0.01) AS lo, quantile_cont(phi, 0.99) AS hi FROM (SELECT marker, domain, atan2({dot3('o', 'y')}, {dot3('o', 'x')}) AS phi FROM od JOIN e8 USING (marker, domain)) GROUP BY ALL),
 st AS (SELECT marker, domain, n, {', '.join(f'greatest(0.0, x{i} * cos({k}) + y{i} * sin({k})) AS {c}{i}' for c, k in (('s', 'lo'), ('t', 'hi')) for i in range(3))} FROM e8 JOIN ph USING (marker, domain)),
 es AS (SELECT marker, domain, n, {unit3('s0', 's1', 's2', 'a')}, {unit3('t0', 't1', 't2', 'b')} FROM st),
 oa AS (SELECT marker, {', '.join(f'CASE WHEN a0 > b0 THEN a{i} ELSE b{i} END AS f{i}, CASE WHEN a0 > b0 THEN b{i} ELSE a{i} END AS g{i}' for i in range(3))} FROM es WHERE domain = 'A'),
 ob AS (SELECT marker, f0, f1, f2, g0, g1, g2, {', '.join(f'CASE WHEN near THEN a{i} ELSE b{i} END AS h{i}, CASE WHEN near THEN b{i} ELSE a{i} END AS k{i}' for i in range(3))}
   FROM (SELECT *, {degrees3('a', 'f')} <= {degrees3('b', 'f')} AS near FROM es JOIN oa USING (marker) WHERE domain = 'B'))"""


def marked(spark, d):
    return big(spark, d).selectExpr("tile % 8 AS marker", "CASE WHEN tile < 8 THEN 'A' ELSE 'B' END AS domain", "r", "g", "b")


@query("a04_a06_stain_vectors", duck(f"SELECT marker, domain, n, {', '.join(f'round(CASE WHEN a0 > b0 THEN a{i} ELSE b{i} END, 4) AS first{i}, round(CASE WHEN a0 > b0 THEN b{i} ELSE a{i} END, 4) AS second{i}' for i in range(3))} FROM es", before=BIG + ", " + PLANE))
def a04(spark, d):
    v = stains.estimate(marked(spark, d), ["marker", "domain"], least=100)
    first, second = stains.order_like(F.col("a"), F.col("b"))
    return v.select("marker", "domain", "n", *[F.round(c[i], 4).alias(f"{name}{i}") for name, c in (("first", first), ("second", second)) for i in range(3)])


@query("a07_two_domains", duck(f"""SELECT marker, round({degrees3('f', 'g')}, 3) AS separation_a, round({degrees3('h', 'k')}, 3) AS separation_b, round({degrees3('f', 'h')}, 3) AS shared_angle,
  CAST(CASE WHEN {degrees3('f', 'g')} < 40 THEN 1 ELSE 0 END + CASE WHEN {degrees3('h', 'k')} < 40 THEN 1 ELSE 0 END AS INT) AS warnings FROM ob""", before=BIG + ", " + PLANE))
def a07(spark, d):
    run = stains.for_run(stains.estimate(marked(spark, d), ["marker", "domain"], least=100), ["marker"], min_separation=40.0)
    return run.select("marker", *[F.round(c, 3).alias(c) for c in ("separation_a", "separation_b", "shared_angle")], F.size("warnings").alias("warnings"))


@query("s07_vector_table", duck(f"SELECT CAST(marker AS VARCHAR) AS marker, 'estimated' AS vectors, 'A' AS domain, round({degrees3('f', 'g')}, 3) AS separation_deg, round(f0, 4) AS red FROM ob UNION ALL SELECT CAST(marker AS VARCHAR), 'estimated', 'B', round({degrees3('h', 'k')}, 3), round(h0, 4) FROM ob", before=BIG + ", " + PLANE))
def s07(spark, d):
    run = stains.for_run(stains.estimate(marked(spark, d).withColumn("marker", F.col("marker").cast("string")), ["marker", "domain"], least=100), ["marker"])
    out = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}/vectors-{uuid.uuid4().hex}"
    images.write_vectors(stains.vector_rows(run, "marker", "estimated"), out)
    return images.read_vectors(spark, out).select("marker", "vectors", "domain", F.round("separation_deg", 3).alias("separation_deg"), F.round(F.col("stain1")[0], 4).alias("red"))


@query("a01_tile_sample", duck("SELECT marker, domain, stem FROM (SELECT *, row_number() OVER (PARTITION BY marker, domain ORDER BY md5(concat('3:', stem, '.png')), stem) AS n FROM tiles) WHERE n <= 20", "tiles"))
def a01_tiles(spark, d):
    return stains.sampled_tiles(tiles(spark, d), ["marker", "domain"], 20, 3).select("marker", "domain", "stem")


@query("a02_tile_pixels")
def a02(spark, d):
    """The two-domain estimate from sampled pixels of sampled tiles, from their bytes; a tile of 8 x 8 gives 48 pixels."""
    run, _ = jobs.estimate_stains(tile_images(spark, d), pixels=48, limit=0)
    return run.select("marker", *[F.round(c, 3).alias(c) for c in ("separation_a", "separation_b", "shared_angle")], F.size("warnings").alias("warnings"))


@query("a01_a02_samples", duck("SELECT vec_id, domain, y, x FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, domain ORDER BY md5(concat('3:', CAST(vec_id AS VARCHAR), ':', domain, ':', CAST(y AS VARCHAR), ':', CAST(x AS VARCHAR))), y, x) AS n FROM pixels) WHERE n <= 16", "pixels"))
def a01(spark, d):
    return stains.sampled_pixels(pixels(spark, d), KEY, 16, 3).select(*KEY, "y", "x")


@query("f01_angles", f"SELECT vec_id, round(degrees(acos(least(1.0, greatest(-1.0, (a0 * {H[0]!r} + a1 * {H[1]!r} + a2 * {H[2]!r}) / sqrt(a0 * a0 + a1 * a1 + a2 * a2))))), 4) AS angle FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a0, CAST(embedding[2] AS DOUBLE) AS a1, CAST(embedding[3] AS DOUBLE) AS a2 FROM embeddings)")
def f01(spark, d):
    v = optics.unit_column(F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")))
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.round(optics.angle(v, F.array(*map(F.lit, H))), 4).alias("angle"))


# ---- diagrams and distances

GRID = """v AS (SELECT vec_id, domain, y, x, round(-(0.299 * r + 0.587 * g + 0.114 * b) / 255.0, 3) AS v FROM pixels),
 corner AS (SELECT vec_id, domain, y + dy AS y, x + dx AS x, min(v) AS v FROM v CROSS JOIN (VALUES (0), (1)) a(dy) CROSS JOIN (VALUES (0), (1)) b(dx) GROUP BY ALL),
 rowedge AS (SELECT vec_id, domain, y + dy AS y, x, min(v) AS v FROM v CROSS JOIN (VALUES (0), (1)) a(dy) GROUP BY ALL),
 coledge AS (SELECT vec_id, domain, y, x + dx AS x, min(v) AS v FROM v CROSS JOIN (VALUES (0), (1)) b(dx) GROUP BY ALL),
 cells AS (SELECT vec_id, domain, v, 1 AS s FROM corner UNION ALL SELECT vec_id, domain, v, -1 FROM rowedge UNION ALL SELECT vec_id, domain, v, -1 FROM coledge UNION ALL SELECT vec_id, domain, v, 1 FROM v)"""


@query("a10_diagrams_euler", duck("SELECT vec_id, domain, t, CAST(sum(CASE WHEN v <= t THEN s ELSE 0 END) AS BIGINT) AS euler FROM cells CROSS JOIN (VALUES (-0.7), (-0.5), (-0.3)) h(t) GROUP BY ALL", "pixels", before=GRID))
def a10_euler(spark, d):
    made = persistence.tile_diagrams(fixtures.images(spark, d), {"A": ["gray"], "B": ["gray"]}, [1], decimals=3)
    low = tiling.measured(made, "low", "double", pa.float64(), lambda x: [round(-v, 3) for v in optics.field_array("gray", x.astype(float)).max((1, 2))])
    each = low.select(*KEY, "low", F.col("diagrams")[0]["d"].alias("d"), F.explode(F.array(*map(F.lit, (-0.7, -0.5, -0.3)))).alias("t"))
    alive = lambda k: F.aggregate(F.zip_with(F.col(f"d.birth{k}"), F.col(f"d.death{k}"), lambda b, x: ((b <= F.col("t")) & (F.col("t") < x)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return each.select(*KEY, "t", ((F.col("low") <= F.col("t")).cast("long") + alive(0) - alive(1)).alias("euler"))


#: Two stain vectors for each marker and domain: other ones for each.
MARKED = {(m, x): tuple(optics.STAINS[n] for n in names) for m, both in {"ER": (("hematoxylin", "eosin"), ("dab", "hematoxylin")), "Ki67": (("eosin", "hematoxylin"), ("hematoxylin", "dab")), "PR": (("hematoxylin", "dab"), ("eosin", "dab"))}.items() for x, names in zip("AB", both, strict=True)}
OWN_CONC = " ".join(f"WHEN m.marker = '{m}' AND p.domain = '{x}' THEN {conc(optics.unit(a), optics.unit(b))}" for (m, x), (a, b) in MARKED.items())


def vector_table(spark, marked=MARKED):
    return spark.createDataFrame([(m, "own", x, list(optics.unit(a)), list(optics.unit(b)), 0.0) for (m, x), (a, b) in marked.items()], images.VECTORS)


@query("p14_marker_vectors", duck("SELECT vec_id, domain, t, CAST(sum(CASE WHEN v <= t THEN s ELSE 0 END) AS BIGINT) AS euler FROM cells CROSS JOIN (VALUES (-0.4), (-0.2), (0.0)) h(t) GROUP BY ALL", "pixels", "tiles", before=GRID.replace(GRID.split(",\n corner")[0], f"v AS (SELECT p.vec_id, p.domain, y, x, round(-(CASE {OWN_CONC} END), 3) AS v FROM pixels p JOIN tiles m USING (vec_id, domain))")))
def p14(spark, d):
    """Diagrams of the field stain1/stain2, which is another one for each marker and domain."""
    held = stains.attached(tile_images(spark, d), vector_table(spark), needed=True)
    made = persistence.tile_diagrams(held, {"A": ["stain1/stain2"], "B": ["stain1/stain2"]}, [1], decimals=3, own=True)
    low = tiling.measured(made, "low", "double", pa.float64(), lambda x, v: [round(float(-c), 3) for c in optics.field_array("stain1/stain2", x.astype(float), vectors=v).max((1, 2))], own=True)
    each = low.select(*KEY, "low", F.col("diagrams")[0]["d"].alias("d"), F.explode(F.array(*map(F.lit, (-0.4, -0.2, 0.0)))).alias("t"))
    alive = lambda k: F.aggregate(F.zip_with(F.col(f"d.birth{k}"), F.col(f"d.death{k}"), lambda b, x: ((b <= F.col("t")) & (F.col("t") < x)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return each.select(*KEY, "t", ((F.col("low") <= F.col("t")).cast("long") + alive(0) - alive(1)).alias("euler"))


SOLVED = lambda v, w: f"(({' + '.join(f'd{i} * {v}{i}' for i in range(3))}) - ({dot3(v, w)}) * ({' + '.join(f'd{i} * {w}{i}' for i in range(3))})) / (1 - {dot3(v, w)} * {dot3(v, w)})"


@query("a07_p14_estimated_fields", duck(f"""SELECT vec_id, domain, round(avg(CASE domain WHEN 'A' THEN {SOLVED('f', 'g')} ELSE {SOLVED('h', 'k')} END), 4) AS level FROM
  (SELECT p.vec_id, p.domain, m.marker, {', '.join(f'{ODF.format(c)} AS d{i}' for i, c in enumerate('rgb'))} FROM pixels p JOIN tiles m USING (vec_id, domain)) q JOIN ob USING (marker) GROUP BY ALL""", "pixels", "tiles", before="px AS (SELECT m.marker, p.domain, r, g, b FROM pixels p JOIN tiles m USING (vec_id, domain)), " + PLANE))
def a07_fields(spark, d):
    """From tiles to each marker's own estimated vectors, through their table, to the field that they give."""
    t = stored(tile_images(spark, d))
    _, vectors = jobs.estimate_stains(t, limit=0, pixels=0)
    level = tiling.measured(stains.attached(t, stored(vectors), needed=True), "level", "double", pa.float64(), lambda x, v: optics.field_array("stain1/stain2", x.astype(float), vectors=v).mean((1, 2)).tolist(), own=True)
    return level.select(*KEY, F.round("level", 4).alias("level"))


@query("a10_s09_critical_pixels", duck("SELECT vec_id, domain, 0 AS off FROM tiles", "tiles"))
def a10_places(spark, d):
    """The written table of diagrams, read again: how many births and deaths of a tile differ from the field at the pixels that are said to give them, or die no later there than they are born. At 6 decimals, as it is written, so a lifetime may be written as 0."""
    t = stored(tile_images(spark, d))
    made = persistence.tile_diagrams(t, {"A": ["gray", "hematoxylin/eosin"], "B": ["gray"]}, [1], places=True)
    out = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}/diagrams-{uuid.uuid4().hex}"
    images.write_diagrams(persistence.diagram_rows(made, ["marker", *KEY], places=True), out, ["marker", "domain"])
    level = {"gray": optics.gray(), "hematoxylin/eosin": optics.field("hematoxylin/eosin")}
    field = pixels(spark, d).select(*KEY, "y", "x", F.explode(F.create_map(*[c for n, v in level.items() for c in (F.lit(n), -v)])).alias("spec", "v"))
    rows = spark.read.parquet(out)
    at = lambda n: field.select(*KEY, "spec", F.col("y").alias(f"{n}_y"), F.col("x").cast("int").alias(f"{n}_x"), F.col("v").alias(f"at_{n}"))
    both = rows.join(at("birth"), [*KEY, "spec", "birth_y", "birth_x"], "left").join(at("death"), [*KEY, "spec", "death_y", "death_x"], "left")
    near = lambda n: F.coalesce(F.abs(F.col(n) - F.col(f"at_{n}")) < 2e-6, F.lit(False))
    # equal levels may differ in the last bits here; different ones are further apart
    lives = (F.col("at_death") - F.col("at_birth") > 1e-12) & (F.col("lifetime") >= 0)
    wrong = both.where(~(near("birth") & near("death") & (F.abs(F.col("lifetime") - F.col("death") + F.col("birth")) < 2e-6) & F.coalesce(lives, F.lit(False)))).groupBy(*KEY).agg(F.count(F.lit(1)).alias("off"))
    return t.select(*KEY).join(wrong, KEY, "left").select(*KEY, F.coalesce("off", F.lit(0)).cast("int").alias("off"))


POINTS = """pt AS (SELECT l_orderkey % 400 AS tile, l_returnflag AS side, CAST(l_linenumber % 2 AS INT) AS dim, CAST(l_discount AS DOUBLE) AS birth, CAST(l_discount AS DOUBLE) + CAST(l_tax AS DOUBLE) + 0.01 AS death FROM lineitem WHERE l_returnflag IN ('A', 'N')),
 q AS (SELECT tile, side, dim, CASE dim WHEN 0 THEN death - birth ELSE birth END AS p FROM pt),
 n AS (SELECT tile, dim, count(*) FILTER (WHERE side = 'A') AS na, count(*) FILTER (WHERE side = 'N') AS nb FROM q GROUP BY ALL),
 padded AS (SELECT tile, dim, side, p FROM q UNION ALL SELECT tile, dim, 'A', 0.0 FROM n CROSS JOIN range(2000) r(i) WHERE i < nb - na UNION ALL SELECT tile, dim, 'N', 0.0 FROM n CROSS JOIN range(2000) r(i) WHERE i < na - nb),
 o AS (SELECT *, row_number() OVER (PARTITION BY tile, dim, side ORDER BY p) AS k FROM padded),
 dist AS (SELECT a.tile, sum(abs(a.p - b.p)) AS d FROM o a JOIN o b ON a.tile = b.tile AND a.dim = b.dim AND a.k = b.k AND a.side = 'A' AND b.side = 'N' WHERE a.tile IN (SELECT tile FROM pt GROUP BY tile HAVING count(DISTINCT side) = 2) GROUP BY a.tile)"""


def point_pairs(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").where("l_returnflag IN ('A', 'N')")
    pts = li.selectExpr("l_orderkey % 400 AS tile", "l_returnflag AS side", "CAST(l_linenumber % 2 AS INT) AS dim", "CAST(l_discount AS DOUBLE) AS birth", "CAST(l_discount AS DOUBLE) + CAST(l_tax AS DOUBLE) + 0.01D AS death")
    p = persistence.packed(pts, ["tile", "side"])
    a, b = p.where("side = 'A'").select("tile", F.struct("p0", "p1").alias("a")), p.where("side = 'N'").select("tile", F.struct("p0", "p1").alias("b"))
    return a.join(b, "tile").select("tile", persistence.distance("a", "b").alias("d"))


@query("a11_a12_distances", duck("SELECT tile, round(d, 6) AS d FROM dist", before=POINTS))
def a11(spark, d):
    return point_pairs(spark, d).select("tile", r6("d").alias("d"))


@query("a13_paired_loss", duck("SELECT count(*) AS n, round(avg(d), 6) AS mean_loss, round(sum(d), 4) AS sum_loss FROM dist", before=POINTS))
def a13(spark, d):
    p = point_diagrams(spark, d)
    both = p.groupBy("tile").count().where("count = 2").select("tile")
    a, b = (side(p, x, n).join(both, "tile", "left_semi") for x, n in (("A", "a"), ("N", "b")))
    return reports.paired_loss(a, b, "tile").select("n", r6("mean_loss").alias("mean_loss"), F.round("sum_loss", 4).alias("sum_loss"))


@query("s09_diagram_rows")
def s09(spark, d):
    """The points of every tile with tissue."""
    some = tiling.tissue(fixtures.images(spark, d)).where("tissue >= 0.5")
    rows = persistence.diagram_rows(persistence.tile_diagrams(some, {"A": ["gray"], "B": ["gray"]}, [1]), KEY)
    return rows.select(*KEY, "dim", *[r6(c).alias(c) for c in ("birth", "death")], r6(F.col("death") - F.col("birth")).alias("lifetime"))


@query("flagship_field_scores")
def flagship(spark, d):
    """Strict wrong partners, inverted grey field, both dimensions: one AUROC a marker."""
    got = sweep.score_fields(tile_images(spark, d), sweep.settings(["gray"], ["gray"], [1], ["0,1"], ["auto"]), shuffles=3, seed=7, decimals=6)
    return got.select("marker", *sweep.COMBO, "true_mean", "wrong_mean", "ratio", "auroc", "auroc_se", "n_tiles", "n_wrong", "n_pairs")


# ---- scores and the audit

SCORED = """q AS (SELECT l_linenumber AS combo, l_returnflag = 'N' AS wrong, round(l_extendedprice, -3) AS v FROM lineitem),
 c AS (SELECT combo, v, count(*) FILTER (WHERE NOT wrong) AS t, count(*) FILTER (WHERE wrong) AS w FROM q GROUP BY ALL),
 u AS (SELECT combo, sum(t * (above + w / 2.0)) / (sum(t) * sum(w)) AS a, sum(t) AS n FROM (SELECT *, coalesce(sum(w) OVER (PARTITION BY combo ORDER BY v DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM c) GROUP BY combo)"""


@query("a16_a18_scores", duck("""SELECT u.combo, CAST(u.n AS BIGINT) AS n_true, round(u.a, 6) AS auroc, round(sqrt(greatest(0.0, (a * (1 - a) + (n - 1) * (a / (2 - a) - a * a) + (n - 1) * (2 * a * a / (1 + a) - a * a)) / (n * n))), 8) AS auroc_se,
  round(m.w / m.t, 6) AS ratio FROM u JOIN (SELECT combo, avg(v) FILTER (WHERE NOT wrong) AS t, avg(v) FILTER (WHERE wrong) AS w FROM q GROUP BY combo) m USING (combo)""", before=SCORED))
def a16(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_linenumber AS combo", "l_returnflag = 'N' AS wrong", "round(l_extendedprice, -3) AS v")
    s = scoring.score_rows(li, ["combo"], "v", "wrong")
    return s.select("combo", "n_true", r6("auroc").alias("auroc"), F.round("auroc_se", 8).alias("auroc_se"), r6("ratio").alias("ratio"))


SET = "field_a, field_b, downsample, dims, projection"
TOP = "top5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY marker, vectors ORDER BY auroc DESC, downsample DESC, combo_no) AS place FROM scores WHERE control = 'strict' AND slice = 1) WHERE place <= 5)"
DECIDED = TOP + f""", conf AS (SELECT t.marker, t.vectors, t.place, {', '.join('t.' + x for x in SET.split(', '))}, t.field_combine, s.auroc AS confirm_auroc, s.n_tiles FROM top5 t JOIN scores s USING (marker, vectors, {SET}) WHERE s.control = 'strict' AND s.slice = 2),
 zc AS (SELECT *, count(*) OVER (PARTITION BY marker) AS n_candidates, (confirm_auroc - 0.5) / sqrt((0.25 + (n_tiles - 1) / 6.0) / (n_tiles * n_tiles)) AS z FROM conf),
 zz AS (SELECT *, z > CASE n_candidates WHEN 10 THEN 2.5758293035489 WHEN 5 THEN 2.32634787404084 END AS supported FROM zc),
 win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY marker ORDER BY supported DESC, confirm_auroc DESC, CASE WHEN supported THEN downsample END DESC, vectors, place) AS rank FROM zz) WHERE rank = 1)"""


def scores(spark, d):
    return fixture(spark, d, "scores")


def halves(spark, d):
    """The screen and the second slice."""
    s = scores(spark, d)
    return s.where("slice = 1"), s.where("slice = 2")


def decided(spark, d):
    return scoring.decided(reports.confirm_set(*halves(spark, d)))


@query("w04_top_candidates", duck(f"SELECT marker, vectors, place, {SET}, auroc FROM top5", "scores", before=TOP))
def w04(spark, d):
    return scoring.top_candidates(halves(spark, d)[0]).select("marker", "vectors", "place", *scoring.SETTING, "auroc")


@query("w06_w07_support", duck("SELECT marker, vectors, place, n_candidates, round(z, 5) AS z_observed, supported FROM zz", "scores", before=DECIDED))
def w06(spark, d):
    return decided(spark, d).select("marker", "vectors", "place", "n_candidates", F.round("z_observed", 5).alias("z_observed"), "supported")


@query("w08_verdicts", duck(f"SELECT marker, CASE WHEN supported THEN 'ph_trans_supported' ELSE 'ph_cyc_only' END AS verdict, vectors, {SET}, confirm_auroc FROM win", "scores", before=DECIDED))
def w08(spark, d):
    return scoring.verdicts(decided(spark, d)).drop("field_combine")


@query("s11_recommendation", duck("""SELECT marker, k.key AS key, coalesce(CASE WHEN k.key = 'FIELD_B' AND marker = 'ER' THEN 'mine' END, CASE k.key WHEN 'FIELD_A' THEN field_a WHEN 'FIELD_B' THEN field_b WHEN 'FIELD_COMBINE' THEN field_combine
   WHEN 'TOPO_DOWNSAMPLE' THEN CAST(downsample AS VARCHAR) WHEN 'TOPO_DIMS' THEN replace(dims, ',', ' ') WHEN 'TOPO_PROJECTION' THEN projection WHEN 'PH_TRANS_SUPPORTED' THEN CASE WHEN supported THEN '1' ELSE '0' END
   ELSE CASE WHEN vectors = 'fixed' THEN '' ELSE vectors END END) AS value
  FROM win CROSS JOIN (VALUES ('FIELD_A'), ('FIELD_B'), ('FIELD_COMBINE'), ('TOPO_DOWNSAMPLE'), ('TOPO_DIMS'), ('TOPO_PROJECTION'), ('STAINS'), ('PH_TRANS_SUPPORTED')) k(key)""", "scores", before=DECIDED))
def s11(spark, d):
    own = scores(spark, d).select("marker").distinct().select("marker", F.lit("FIELD_B").alias("key"), F.when(F.col("marker") == "ER", "mine").otherwise("").alias("value"))
    return scoring.recommendation(scoring.verdicts(decided(spark, d)), own)


@query("w09_best_and_cheapest", duck(f"""SELECT marker, vectors, control, {SET}, auroc FROM (SELECT *, max(CASE WHEN b = 1 THEN downsample END) OVER w AS bd, row_number() OVER (PARTITION BY marker, vectors, control ORDER BY downsample DESC, combo_no) AS c FROM
  (SELECT *, row_number() OVER (PARTITION BY marker, vectors, control ORDER BY auroc DESC, combo_no) AS b, max(auroc) OVER (PARTITION BY marker, vectors, control) AS m FROM scores WHERE slice = 1) WHERE auroc >= m - 0.01 WINDOW w AS (PARTITION BY marker, vectors, control))
  WHERE b = 1 OR (c = 1 AND downsample > bd)""", "scores"))
def w09(spark, d):
    by = ["marker", "vectors", "control"]
    return scoring.cheapest(halves(spark, d)[0], by).select(*by, *scoring.SETTING, "auroc")


@query("a19_arms", duck("""SELECT marker, vectors, max(auroc) FILTER (WHERE control = 'strict') AS best_strict, max(auroc) FILTER (WHERE control = 'unstratified') AS best_free,
  round(max(auroc) FILTER (WHERE control = 'unstratified') - max(auroc) FILTER (WHERE control = 'strict'), 6) AS delta FROM scores WHERE slice = 1 GROUP BY ALL HAVING max(auroc) FILTER (WHERE control = 'strict') IS NOT NULL""", "scores"))
def a19(spark, d):
    return scoring.arms(halves(spark, d)[0]).withColumn("delta", r6("delta"))


@query("a20_a23_tally", duck(f"SELECT {SET}, count(DISTINCT marker) AS n_markers, string_agg(DISTINCT marker, ',' ORDER BY marker) AS markers FROM zz WHERE supported GROUP BY ALL HAVING count(DISTINCT marker) > 1", "scores", before=DECIDED))
def a20(spark, d):
    return scoring.tally(decided(spark, d))


@query("s08_score_table", duck("SELECT marker, vectors, control, CASE slice WHEN 1 THEN 'screen' ELSE 'confirm' END AS stage, count(*) AS n, round(sum(auroc * (1 + combo_no)), 4) AS s FROM scores GROUP BY ALL", "scores"))
def s08(spark, d):
    out = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}/scores-{uuid.uuid4().hex}"
    for _ in range(2):  # a run that is written again leaves the table as it was
        for rows, stage in zip(halves(spark, d), ("screen", "confirm"), strict=True):
            images.append_scores(rows.withColumn("stage", F.lit(stage)), out)
    got = spark.read.parquet(out).groupBy("marker", "vectors", "control", "stage")
    return got.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("auroc") * (1 + F.col("combo_no"))), 4).alias("s"))


GRID3 = ["gray", "hematoxylin/eosin", "eosin/hematoxylin"], ["gray", "dab+hematoxylin", "dab/hematoxylin"], [1, 2, 4]
LISTED = lambda values: ", ".join(f"({i}, {v!r})" for i, v in enumerate(values))


@query("j07_sweep_grid", duck(f"""SELECT marker, CAST(fa.i * 108 + fb.i * 36 + ds.i * 12 + dm.i * 4 + pr.i AS INT) AS combo_no, fa.f AS field_a, fb.f AS field_b, ds.f AS downsample, dm.f AS dims, pr.f AS projection, count(*) AS n_pairs FROM tp
  CROSS JOIN (VALUES {LISTED(GRID3[0])}) fa(i, f) CROSS JOIN (VALUES {LISTED(GRID3[1])}) fb(i, f) CROSS JOIN (VALUES {LISTED(GRID3[2])}) ds(i, f)
  CROSS JOIN (VALUES {LISTED(list(sweep.DIMS))}) dm(i, f) CROSS JOIN (VALUES {LISTED(sweep.PROJECTIONS)}) pr(i, f) GROUP BY ALL""", "tiles", before=PAIRS))
def j07(spark, d):
    n = pairs(spark, d).groupBy("marker").agg(F.count(F.lit(1)).alias("n_pairs"))
    return n.crossJoin(F.broadcast(sweep.combinations(spark, sweep.settings(*GRID3))))  # markers times settings


@query("x01_inference", "SELECT vec_id, round(avg(least(1.0, greatest(0.0, (0.5 * v + 0.1 + 1) / 2))), 5) AS mean_out FROM (SELECT vec_id, unnest(embedding) AS v FROM embeddings) GROUP BY vec_id")
def x01(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").alias("tile"))
    out = tiling.translate(e, "tile", lambda: lambda x: 0.5 * x + 0.1, 64)
    return out.select("vec_id", F.round(F.aggregate("out", F.lit(0.0), lambda s, x: s + x) / F.size("out"), 5).alias("mean_out"))


# ---- reports over diagrams


def listed(a: str, b: str) -> str:
    """DuckDB: distance of two lists of values, the shorter padded with zeros before both are sorted."""
    pad = lambda x, y: f"list_sort(list_concat(coalesce({x}, []), list_resize([]::DOUBLE[], greatest(0, len(coalesce({y}, [])) - len(coalesce({x}, []))), 0.0)))"
    return f"coalesce(list_sum(list_transform(list_zip({pad(a, b)}, {pad(b, a)}), lambda z: abs(z[1] - z[2]))), 0.0)"


PACKED = """pk AS (SELECT tile, side, list(death - birth) FILTER (WHERE dim = 0) AS p0, list(birth) FILTER (WHERE dim = 1) AS p1 FROM pt GROUP BY ALL)"""
POINT_ROWS = POINTS.split(",\n q AS")[0] + ", " + PACKED


def point_diagrams(spark, d):
    """(tile, side, g): packed diagrams of both sides."""
    li = spark.read.parquet(f"{d}/lineitem.parquet").where("l_returnflag IN ('A', 'N')")
    pts = li.selectExpr("l_orderkey % 400 AS tile", "l_returnflag AS side", "CAST(l_linenumber % 2 AS INT) AS dim", "CAST(l_discount AS DOUBLE) AS birth", "CAST(l_discount AS DOUBLE) + CAST(l_tax AS DOUBLE) + 0.01D AS death")
    return persistence.packed(pts, ["tile", "side"]).select("tile", "side", F.struct("p0", "p1").alias("g"))


def side(p, s, name):
    return p.where(F.col("side") == s).select("tile", F.col("g").alias(name))


@query("a21_inspected_pairs", duck(f"""SELECT a.tile, round({listed('a.p0', 'b.p0')}, 6) AS d0, round({listed('a.p1', 'b.p1')}, 6) AS d1, CAST(len(coalesce(a.p0, [])) AS INT) AS points0_a, CAST(len(coalesce(b.p1, [])) AS INT) AS points1_b
  FROM pk a JOIN pk b ON a.tile = b.tile AND a.side = 'A' AND b.side = 'N'""", before=POINT_ROWS))
def a21(spark, d):
    p = point_diagrams(spark, d)
    return reports.inspected(side(p, "A", "a").join(side(p, "N", "b"), "tile")).select("tile", r6("d0").alias("d0"), r6("d1").alias("d1"), "points0_a", "points1_b")


@query("a21_inspection_summary", duck(f"""SELECT a.tile % 3 AS marker, count(*) AS n, round(avg({listed('a.p0', 'b.p0')} + {listed('a.p1', 'b.p1')}), 6) AS mean_total, round(min({listed('a.p0', 'b.p0')} + {listed('a.p1', 'b.p1')}), 6) AS min_total,
  round(max({listed('a.p0', 'b.p0')} + {listed('a.p1', 'b.p1')}), 6) AS max_total FROM pk a JOIN pk b ON a.tile = b.tile AND a.side = 'A' AND b.side = 'N' GROUP BY ALL""", before=POINT_ROWS))
def a21_summary(spark, d):
    p = point_diagrams(spark, d)
    rows = reports.inspected(side(p, "A", "a").join(side(p, "N", "b"), "tile")).withColumn("marker", F.col("tile") % 3)
    return reports.inspection_summary(rows, ["marker"]).select("marker", "n", *[r6(c).alias(c) for c in ("mean_total", "min_total", "max_total")])


def costs(spark, d):
    p = point_diagrams(spark, d)
    left, right = (side(p, s, x).withColumn("batch", F.col("tile") % 40).withColumnRenamed("tile", f"tile_{x}") for s, x in (("A", "a"), ("N", "b")))
    return reports.cost_matrix(left, right, "batch")


@query("j12_cost_matrix", duck(f"""SELECT a.tile % 40 AS batch, a.tile AS tile_a, b.tile AS tile_b, round({listed('a.p0', 'b.p0')} + {listed('a.p1', 'b.p1')}, 6) AS cost
  FROM pk a JOIN pk b ON a.tile % 40 = b.tile % 40 AND a.side = 'A' AND b.side = 'N'""", before=POINT_ROWS))
def j12(spark, d):
    return costs(spark, d).select("batch", "tile_a", "tile_b", r6("cost").alias("cost"))


@query("a14_matched_loss")
def a14(spark, d):
    return reports.matched_loss(costs(spark, d), "batch", "tile_a", "tile_b").select("batch", "matched", r6("mean_loss").alias("mean_loss"), r6("sum_loss").alias("sum_loss"))


@query("a14_matched_sets", duck("""SELECT batch, CAST(least(m, k) AS BIGINT) AS matched, round(coalesce(best, 0) / greatest(1, least(m, k)), 6) AS mean_loss, round(coalesce(best, 0), 6) AS sum_loss FROM
  (SELECT batch, max(m) AS m, max(k) AS k FROM (SELECT batch, count(*) AS m, 0 AS k FROM lf_ GROUP BY batch UNION ALL SELECT batch, 0, count(*) FROM rt_ GROUP BY batch) GROUP BY batch)
  LEFT JOIN (SELECT batch, min(cost) AS best FROM step JOIN sizes USING (batch) WHERE i = m AND taken = least(m, k) GROUP BY batch) USING (batch)""", before=POINT_ROWS + f""",
 lf_ AS (SELECT tile // 4 AS batch, tile, p0, p1, row_number() OVER (PARTITION BY tile // 4 ORDER BY tile) AS i FROM pk WHERE side = 'A' AND tile // 4 % 5 <> 0),
 rt_ AS (SELECT tile // 4 AS batch, tile, p0, p1, row_number() OVER (PARTITION BY tile // 4 ORDER BY tile) AS j FROM pk WHERE side = 'N' AND tile % 3 <> 1 AND tile // 4 % 7 <> 3),
 sizes AS (SELECT batch, m, k FROM (SELECT batch, count(*) AS m FROM lf_ GROUP BY batch) JOIN (SELECT batch, count(*) AS k FROM rt_ GROUP BY batch) USING (batch)),
 cost AS (SELECT a.batch, a.i, b.j, {listed('a.p0', 'b.p0')} + {listed('a.p1', 'b.p1')} AS c FROM lf_ a JOIN rt_ b USING (batch)),
 step AS (WITH RECURSIVE s(batch, i, used, taken, cost) AS (SELECT batch, 0, []::BIGINT[], 0, 0.0::DOUBLE FROM sizes
   UNION ALL SELECT s.batch, s.i + 1, CASE WHEN o.j IS NULL THEN s.used ELSE list_append(s.used, o.j) END, s.taken + CASE WHEN o.j IS NULL THEN 0 ELSE 1 END, s.cost + coalesce(o.c, 0)
   FROM s JOIN sizes z ON z.batch = s.batch AND s.i < z.m JOIN (SELECT batch, i, j, c FROM cost UNION ALL SELECT DISTINCT batch, i, NULL, NULL FROM cost) o ON o.batch = s.batch AND o.i = s.i + 1 AND (o.j IS NULL OR NOT list_contains(s.used, o.j)))
   SELECT * FROM s)"""))
def a14_sets(spark, d):
    """Batches of up to four diagrams a side, some with an empty one, against all assignments."""
    p = point_diagrams(spark, d)
    left = side(p, "A", "a").withColumn("batch", F.expr("tile div 4")).where("batch % 5 <> 0").withColumnRenamed("tile", "tile_a")
    right = side(p, "N", "b").withColumn("batch", F.expr("tile div 4")).where("tile % 3 <> 1 AND batch % 7 <> 3").withColumnRenamed("tile", "tile_b")
    return reports.matched_sets(left, right, "batch", "tile_a", "tile_b").select("batch", "matched", r6("mean_loss").alias("mean_loss"), r6("sum_loss").alias("sum_loss"))


ROLE = "element_at(array('real_A', 'rec_A', 'fake_B', 'real_B', 'rec_B', 'fake_A'), CAST(1 + l_linenumber % 6 AS INT))"
ROLED = """pt AS (SELECT l_returnflag AS run, l_orderkey % 100 AS tile, list_extract(['real_A', 'rec_A', 'fake_B', 'real_B', 'rec_B', 'fake_A'], 1 + l_linenumber % 6) AS role, l_suppkey % 2 AS dim,
  CAST(l_discount AS DOUBLE) AS birth, CAST(l_discount AS DOUBLE) + CAST(l_tax AS DOUBLE) + 0.01 AS death FROM lineitem),
 pk AS (SELECT run, tile, role, list(death - birth) FILTER (WHERE dim = 0) AS p0, list(birth) FILTER (WHERE dim = 1) AS p1 FROM pt GROUP BY ALL),
 whole AS (SELECT run, tile, count(*) = 6 AS ok FROM pk GROUP BY ALL),
 """ + f"""term AS (SELECT a.run, n.name, avg({listed('a.p0', 'b.p0')} + {listed('a.p1', 'b.p1')}) AS d FROM
  (VALUES ('cyc_h', 'real_A', 'rec_A'), ('cyc_i', 'real_B', 'rec_B'), ('trans_h', 'real_A', 'fake_B'), ('trans_i', 'real_B', 'fake_A')) n(name, x, y)
  JOIN pk a ON a.role = n.x JOIN pk b ON b.role = n.y AND a.run = b.run AND a.tile = b.tile JOIN whole w ON w.ok AND w.run = a.run AND w.tile = a.tile GROUP BY ALL)"""


@query("a15_topology_report", duck("""SELECT w.run, round(t.h, 6) AS cyc_h, round(t.i, 6) AS cyc_i, round(t.th, 6) AS trans_h, round(t.ti, 6) AS trans_i, w.n_tiles, w.incomplete, round(0.1 * (10 * (t.h + t.i) + (t.th + t.ti)), 6) AS total FROM
  (SELECT run, count(*) FILTER (WHERE ok) AS n_tiles, count(*) FILTER (WHERE NOT ok) AS incomplete FROM whole GROUP BY run) w LEFT JOIN
  (SELECT run, max(d) FILTER (WHERE name = 'cyc_h') AS h, max(d) FILTER (WHERE name = 'cyc_i') AS i, max(d) FILTER (WHERE name = 'trans_h') AS th, max(d) FILTER (WHERE name = 'trans_i') AS ti FROM term GROUP BY run) t USING (run)""", before=ROLED))
def a15(spark, d):
    pts = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_returnflag AS run", "l_orderkey % 100 AS tile", f"{ROLE} AS role", "l_suppkey % 2 AS dim", "CAST(l_discount AS DOUBLE) AS birth", "CAST(l_discount AS DOUBLE) + CAST(l_tax AS DOUBLE) + 0.01D AS death")
    got = reports.topology_report(persistence.packed(pts, ["run", "tile", "role"]), ["run"], cyc=10.0, scale=0.1)
    return got.select("run", *[r6(t).alias(t) for t in reports.TERMS], "n_tiles", "incomplete", r6("total").alias("total"))


@query("j08_sweep_scores")
def j08(spark, d):
    """All 324 settings over the tiles, one score row for each marker and setting."""
    got = sweep.score_fields(tile_images(spark, d), sweep.settings(*GRID3), seed=7, decimals=6)
    return got.select("marker", "combo_no", *sweep.COMBO, "true_mean", "wrong_mean", "ratio", "auroc", "auroc_se", "n_tiles", "n_wrong")


@query("j08_sweep_128_tiles")
def j08_big(spark, d):
    """All 324 settings over 128 pairs of larger tiles. A tile takes as many rows of `lineitem` as the square of the smallest one; the few past that are no pixels."""
    got = sweep.score_fields(fixtures.big_images(spark, d, 128), sweep.settings(*GRID3), seed=7, decimals=6)
    return got.select("marker", "combo_no", *sweep.COMBO, "true_mean", "wrong_mean", "ratio", "auroc", "auroc_se", "n_tiles", "n_wrong")


@query("a10_big_diagrams")
def a10_big(spark, d):
    """How many points the grey field of each larger tile has. A tile takes as many rows of `lineitem` as the square of the smallest one; the few past that are no pixels."""
    made = persistence.tile_diagrams(fixtures.big_images(spark, d, 36), {"A": ["gray"], "B": ["gray"]}, [1])
    one = F.col("diagrams")[0]["d"]
    return made.select("domain", "stem", "h", "w", F.size(one["birth0"]).alias("points0"), F.size(one["birth1"]).alias("points1"))


#: Diagrams from lineitem for two fields and two downsamplings of 40 tiles a side; the true pair of tile t is (t, t), the wrong one (t, t + 1).
MANY = """pt AS (SELECT CAST(l_orderkey % 40 AS INT) AS tile, CASE l_returnflag WHEN 'N' THEN 'B' ELSE 'A' END AS domain, CASE l_partkey % 2 WHEN 0 THEN 'f0' ELSE 'f1' END AS spec, CAST(1 + l_suppkey % 2 AS INT) AS downsample,
  CAST(l_linenumber % 2 AS INT) AS dim, CAST(l_discount AS DOUBLE) - 0.05 AS birth, CAST(l_discount AS DOUBLE) - 0.05 + CAST(l_tax AS DOUBLE) + 0.01 * (1 + l_orderkey % 40 % 5) AS death FROM lineitem)"""
MANY_SQL = MANY + f""", li AS (SELECT tile, domain, spec, downsample, dim, k.kind AS kind, list(CASE k.kind WHEN 'birth' THEN birth WHEN 'death' THEN death ELSE death - birth END) AS v FROM pt CROSS JOIN (VALUES ('birth'), ('death'), ('lifetime')) k(kind) GROUP BY ALL),
 pr AS (SELECT t AS a, t AS b, false AS wrong FROM range(40) r(t) UNION ALL SELECT t, (t + 1) % 40, true FROM range(40) r(t)),
 grid AS (SELECT fa.f AS fa, fb.f AS fb, k.k AS ds, d.d AS dim, p.p AS kind FROM (VALUES ('f0'), ('f1')) fa(f) CROSS JOIN (VALUES ('f0'), ('f1')) fb(f) CROSS JOIN (VALUES (1), (2)) k(k) CROSS JOIN (VALUES (0), (1)) d(d) CROSS JOIN (VALUES ('birth'), ('death'), ('lifetime')) p(p)),
 one AS (SELECT pr.a, pr.b, pr.wrong, g.fa, g.fb, g.ds, g.dim, g.kind, {listed('x.v', 'y.v')} AS d FROM pr CROSS JOIN grid g
   LEFT JOIN li x ON x.tile = pr.a AND x.domain = 'A' AND x.spec = g.fa AND x.downsample = g.ds AND x.dim = g.dim AND x.kind = g.kind
   LEFT JOIN li y ON y.tile = pr.b AND y.domain = 'B' AND y.spec = g.fb AND y.downsample = g.ds AND y.dim = g.dim AND y.kind = g.kind),
 se AS (SELECT * FROM (VALUES (0, '0'), (1, '1'), (2, '0,1')) d(di, dims) CROSS JOIN (VALUES (0, 'auto'), (1, 'birth'), (2, 'death'), (3, 'lifetime')) p(pi, projection)),
 q AS (SELECT CAST((CASE fa WHEN 'f0' THEN 0 ELSE 48 END) + (CASE fb WHEN 'f0' THEN 0 ELSE 24 END) + 12 * (ds - 1) + 4 * di + pi AS INT) AS combo_no, fa AS field_a, fb AS field_b, ds AS downsample, dims, projection, a, wrong, round(sum(d), 6) AS v
   FROM one JOIN se ON (dims = '0,1' OR dims = CAST(dim AS VARCHAR)) AND kind = CASE projection WHEN 'auto' THEN CASE dim WHEN 0 THEN 'lifetime' ELSE 'birth' END ELSE projection END GROUP BY ALL),
 c AS (SELECT combo_no, v, count(*) FILTER (WHERE NOT wrong) AS t, count(*) FILTER (WHERE wrong) AS w FROM q GROUP BY ALL),
 u AS (SELECT combo_no, sum(t * (above + w / 2.0)) / (sum(t) * sum(w)) AS auroc FROM (SELECT *, coalesce(sum(w) OVER (PARTITION BY combo_no ORDER BY v DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM c) GROUP BY combo_no)"""


@query("j08_point_scores", duck("SELECT combo_no, field_a, field_b, downsample, dims, projection, round(avg(v) FILTER (WHERE NOT wrong), 5) AS true_mean, round(auroc, 8) AS auroc FROM q JOIN u USING (combo_no) GROUP BY ALL", before=MANY_SQL))
def j08_points(spark, d):
    spark.read.parquet(f"{d}/lineitem.parquet").createOrReplaceTempView("lineitem")
    pts = spark.sql(f"WITH {MANY} SELECT * FROM pt")
    lists = pts.groupBy("tile", "domain", "spec", "downsample").agg(*[F.collect_list(F.when(F.col("dim") == k, F.col(c))).alias(f"{c}{k}") for k in (0, 1) for c in ("birth", "death")])
    packed = lists.groupBy("tile", "domain").agg(F.collect_list(F.struct("spec", "downsample", F.struct("birth0", "death0", "birth1", "death1").alias("d"))).alias("diagrams"))
    made = sweep.sorted_projections(packed)
    a, b = (made.where(F.col("domain") == x.upper()).select(F.col("tile").alias(f"t{x}"), F.col("diagrams").alias(x)) for x in "ab")
    both = spark.range(40).select(F.col("id").alias("ta"), F.explode(F.array(F.struct(F.col("id").alias("tb"), F.lit(False).alias("wrong")), F.struct(((F.col("id") + 1) % 40).alias("tb"), F.lit(True).alias("wrong")))).alias("p")).select("ta", "p.*")
    chosen = sweep.settings(["f0", "f1"], ["f0", "f1"], [1, 2])
    rows = sweep.setting_distances(both.join(a, "ta").join(b, "tb"), "a", "b", chosen, 6)
    rows = rows.withColumns({"true_pairs": (~F.col("wrong")).cast("long"), "wrong_pairs": F.col("wrong").cast("long")})
    return sweep.by_setting(rows, [], chosen).select("combo_no", *sweep.COMBO, F.round("true_mean", 5).alias("true_mean"), F.round("auroc", 8).alias("auroc"))


@query("audit_verdicts")
def audited(spark, d):
    """The whole audit over the tiles: two sources of vectors, screen and confirmation, one decision for each marker."""
    other = {"A": {"hematoxylin": (0.6, 0.72, 0.35)}, "B": {"hematoxylin": (0.6, 0.72, 0.35), "dab": (0.25, 0.55, 0.8)}}
    grid = sweep.settings(["gray", "hematoxylin/eosin"], ["gray", "dab+hematoxylin"], [1, 2], ["0", "0,1"], ["auto"])
    out = jobs.audit(tile_images(spark, d), {"fixed": (grid, None), "other": (grid, other)}, seed=7, decimals=6)
    return out["decided"].select("marker", "vectors", "place", *scoring.SETTING, r6("confirm_auroc").alias("confirm_auroc"), "n_tiles", "n_candidates", "supported", "rank")


@query("w02_audit_slices", duck("""SELECT marker, v.vectors, c.control, c.stage, c.k * half AS "offset", half AS "limit", count(*) AS n_pairs, count(*) FILTER (WHERE c.control = 'unstratified' OR near > 1) AS n_tiles, CASE WHEN c.control = 'strict' THEN count(DISTINCT slide) ELSE 0 END AS groups
  FROM (SELECT *, count(*) OVER (PARTITION BY marker, slide, pair_idx // half) AS near FROM (SELECT *, greatest(1, count(*) OVER (PARTITION BY marker) // 2) AS half FROM tp))
  JOIN (VALUES ('screen', 'strict', 0), ('screen', 'unstratified', 0), ('confirm', 'strict', 1)) c(stage, control, k) ON pair_idx // half = c.k CROSS JOIN (VALUES ('fixed'), ('estimated')) v(vectors) GROUP BY marker, v.vectors, c.control, c.stage, c.k, half""", "tiles", before=PAIRS))
def w02_audit(spark, d):
    """The audit's slices, each half of its marker's own pairs, with the vectors of the literature and a table of each marker's own."""
    t = stored(tile_images(spark, d))
    _, vectors = jobs.estimate_stains(t, pixels=16, limit=40, least=100)
    one = lambda a, b: sweep.settings([a], [b], [2], ["0"], ["auto"])
    got = jobs.audit(t, {"fixed": (one("gray", "gray"), None), "estimated": (one("stain1/stain2", "stain2/stain1"), stored(vectors))}, seed=7, decimals=6)
    both = got["screen"].withColumn("stage", F.lit("screen")).unionByName(got["second"].withColumn("stage", F.lit("confirm")))
    return both.select("marker", "vectors", "control", "stage", "offset", "limit", "n_pairs", "n_tiles", F.coalesce("groups", F.lit(0)).alias("groups"))


@query("estimate_and_score")
def estimated(spark, d):
    """Vectors from the slides that a seeded draw leaves for training, scores on the slides held out."""
    t = stored(pairing.holdout(tile_images(spark, d), 0.5, 7))
    train, val = (t.where(F.col("split") == x).drop("split") for x in ("train", "val"))
    got = jobs.estimate_and_score(train, val, estimate={"pixels": 48, "limit": 0}, shuffles=3, seed=7, decimals=6)["scores"]
    return got.select("marker", "vectors", "combo_no", *sweep.COMBO, *[r6(c).alias(c) for c in ("true_mean", "wrong_mean", "auroc", "auroc_se")], "n_tiles", "n_wrong", "n_pairs", "groups", "sample", "slide_regex", "image_size", "invert")


@query("x02_pair_vectors", duck(f"""SELECT regexp_extract(marker, '^[^/]+') AS marker, CAST(regexp_extract(marker, '[0-9]+$') AS BIGINT) AS pair_idx, round({degrees3('f', 'g')}, 3) AS separation_a, round({degrees3('h', 'k')}, 3) AS separation_b, round({degrees3('f', 'h')}, 3) AS shared_angle FROM ob""", "tiles", "pixels",
   before=TISSUE + ", shown AS (SELECT tiles.* FROM tiles JOIN t USING (vec_id, domain) WHERE tissue >= 0.5), " + PAIRS.replace("FROM tiles a JOIN tiles b", "FROM shown a JOIN shown b") + """,
  px AS (SELECT concat(tp.marker, '/', CAST(pair_idx AS VARCHAR)) AS marker, p.domain, r, g, b FROM tp JOIN shown s ON s.marker = tp.marker AND s.stem = tp.stem JOIN pixels p ON p.vec_id = s.vec_id AND p.domain = s.domain WHERE pair_idx < 40), """ + PLANE))
def x02_vectors(spark, d):
    """Stain vectors of inspected pairs, estimated from each pair's own two tiles."""
    shown = tiling.tissue(tile_images(spark, d)).where("tissue >= 0.5").drop("tissue")
    got = jobs.inspect_pairs(shown, "stain1/stain2", "stain1+stain2", 40, seed=7, vectors="pair", least=2)
    a, b = (got["vectors"].where(F.col("domain") == x).select("marker", "pair_idx", F.col("stain1").alias(f"first_{x}"), F.col("separation_deg").alias(f"separation_{x.lower()}")) for x in "AB")
    angle = optics.angle(F.col("first_A"), F.col("first_B"))
    return a.join(b, ["marker", "pair_idx"]).select("marker", "pair_idx", *[F.round(c, 3).alias(c) for c in ("separation_a", "separation_b")], F.round(angle, 3).alias("shared_angle"))


def inspection(spark, d):
    return jobs.inspect_pairs(tile_images(spark, d), "hematoxylin/eosin", "dab+hematoxylin", 40, seed=7)


LEVEL = "CAST(least(255.0, greatest(0.0, round_even(255.0 * pow(10.0, -greatest({}, 0.0)), 0))) AS INT)"


@query("x02_inspected_channels", duck(f"""SELECT marker, pair_idx, domain, channel, sum(CASE channel WHEN 'hematoxylin/eosin' THEN {LEVEL.format(conc(H, E))} WHEN 'eosin/hematoxylin' THEN {LEVEL.format(conc(E, H))}
   WHEN 'dab/hematoxylin' THEN {LEVEL.format(conc(D, H))} WHEN 'hematoxylin/dab' THEN {LEVEL.format(conc(H, D))} ELSE {LEVEL.format(f'({conc(D, H)} + {conc(H, D)})')} END) AS level
  FROM tp JOIN tiles USING (marker, stem) JOIN pixels USING (vec_id, domain) JOIN (VALUES ('A', 'hematoxylin/eosin'), ('A', 'eosin/hematoxylin'), ('B', 'dab/hematoxylin'), ('B', 'hematoxylin/dab'), ('B', 'dab+hematoxylin')) c(domain, channel) USING (domain)
  WHERE pair_idx < 40 GROUP BY ALL""", "tiles", "pixels", before=PAIRS))
def x02(spark, d):
    got = inspection(spark, d)["channels"]
    return got.select("marker", "pair_idx", "domain", "channel", F.aggregate("levels", F.lit(0).cast("long"), lambda s, x: s + x).alias("level"))


@query("x02_inspected_distances")
def x02_distances(spark, d):
    got = inspection(spark, d)["distances"]
    return got.select("marker", "pair_idx", *[r6(c).alias(c) for c in ("d0", "d1", "total")], *[f"points{k}_{x}" for k in (0, 1) for x in "ab"])


@query("w05_confirm_set", duck(f"SELECT marker, vectors, place, {SET}, confirm_auroc, n_tiles FROM conf", "scores", before=DECIDED))
def w05(spark, d):
    return reports.confirm_set(*halves(spark, d)).select("marker", "vectors", "place", *scoring.SETTING, "confirm_auroc", "n_tiles")


@query("a23_marker_lists", duck("SELECT verdict, count(*) AS n_markers, string_agg(marker, ', ' ORDER BY marker) AS markers FROM (SELECT marker, CASE WHEN supported THEN 'ph_trans_supported' ELSE 'ph_cyc_only' END AS verdict FROM win) GROUP BY verdict", "scores", before=DECIDED))
def a23(spark, d):
    return reports.marker_lists(scoring.verdicts(decided(spark, d)))


@query("a23_f03_report_rows", duck("""SELECT marker, row_number() OVER (PARTITION BY marker ORDER BY confirm_auroc DESC, vectors, place) AS line, vectors,
  concat(field_a, ' / ', field_b, '  ds=', CAST(downsample AS VARCHAR), ' dims=', dims, ' proj=', projection) AS setting, n_tiles, confirm_auroc, round(z, 5) AS z_observed, supported FROM zz""", "scores", before=DECIDED))
def a23_rows(spark, d):
    return reports.report_rows(decided(spark, d)).withColumn("z_observed", F.round("z_observed", 5))


ORIGINS = """f AS (SELECT vec_id, concat('file:///data/', CASE vec_id % 3 WHEN 0 THEN 'HE/train/' WHEN 1 THEN 'IHC/train/' ELSE concat('c', CAST(vec_id % 7 AS VARCHAR), '/images/') END, 't', CAST(vec_id AS VARCHAR), '.png') AS origin FROM embeddings)"""


def origins(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.selectExpr("vec_id", "concat('file:///data/', CASE vec_id % 3 WHEN 0 THEN 'HE/train/' WHEN 1 THEN 'IHC/train/' ELSE concat('c', CAST(vec_id % 7 AS STRING), '/images/') END, 't', CAST(vec_id AS STRING), '.png') AS origin")


@query("s03_split_mapping", duck("SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 'trainA' ELSE 'IHC/train' END AS split FROM f WHERE vec_id % 3 < 2", before=ORIGINS))
def s03(spark, d):
    return images.with_split(origins(spark, d), "/data", ["HE/train:trainA", "IHC/train", "absent:valA"]).select("vec_id", "split")


@query("s02_tiling_counts", duck("""SELECT slide, domain, CASE WHEN slide LIKE '%3' THEN 0 ELSE count(*) FILTER (WHERE tissue >= 0.5) END AS written, CASE WHEN slide LIKE '%3' THEN 0 ELSE count(*) FILTER (WHERE tissue < 0.5) END AS skipped
  FROM crop GROUP BY slide, domain""", "tiles", "pixels", before=CROPS))
def s02(spark, d):
    """Crops written and skipped of each source image; images that can't be decoded (slides that end in 3) count 0 and 0."""
    src = fixture(spark, d, "sources").select(F.concat("slide", F.lit("/"), "domain").alias("origin"), "slide", "domain", "h", "w", F.when(~F.col("slide").endswith("3"), F.col("rgb")).alias("rgb"))
    crops = tiling.tissue(tiling.cropped(src.where("rgb IS NOT NULL"), 8, 4)).withColumn("kept", F.col("tissue") >= 0.5)
    got = images.tiling_counts(crops, src, "kept")
    return got.select(F.split("origin", "/")[0].alias("slide"), F.split("origin", "/")[1].alias("domain"), "written", "skipped")


@query("s04_case_index", duck("SELECT concat('c', CAST(vec_id % 7 AS VARCHAR)) AS case_id, concat('t', CAST(vec_id AS VARCHAR)) AS id, origin FROM f WHERE vec_id % 3 = 2", before=ORIGINS))
def s04(spark, d):
    return images.case_index(origins(spark, d))
