"""Tile operators: every query with SQL against DuckDB on the smallest tables, and literal cases."""

import math
import struct
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mosaica.functions import optics
from mosaica.operators import ordering, pairing, persistence, reports, scoring, stains, sweep, tiling
from mosaica.plans import jobs
from mosaica.plans.queries import ORACLE, QUERIES
from mosaica.sources import images

DATA = "/root/testdata/sf0.001"


def rows_of(df):
    cols = sorted(df.columns)
    show = lambda x: f"{x:.9g}" if isinstance(x, float) else str(x)
    return cols, sorted(tuple(show(x) for x in r) for r in df[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "embeddings"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    assert rows_of(QUERIES[name](spark, DATA).toPandas()) == rows_of(con.execute(ORACLE[name]).df())


def pairs_of(field, dim):
    return sorted((b, d) for k, b, d, *_ in persistence.diagram(np.array(field, float)) if k == dim)


def test_diagram_of_a_well():
    field = [[0, 3, 0], [3, 5, 3], [0, 3, 0]]
    assert pairs_of(field, 0) == [(0, 3)] * 3
    assert pairs_of(field, 1) == [(3, 5)]


def test_diagonal_pixels_touch():
    assert pairs_of([[0, 9], [9, 0]], 0) == []


@pytest.mark.parametrize("seed", range(6))
def test_diagram_agrees_with_the_euler_characteristic(seed):
    f = np.round(np.random.default_rng(seed).random((7, 9)), 1 + seed % 2)
    points = persistence.diagram(f)
    assert all(b < d and f[by, bx] == b and f[dy, dx] == d for _, b, d, by, bx, dy, dx in points)
    pad = np.pad(f, 1, constant_values=np.inf)
    corner = np.minimum.reduce([pad[:-1, :-1], pad[1:, :-1], pad[:-1, 1:], pad[1:, 1:]])
    across, down = np.minimum(pad[1:-1, :-1], pad[1:-1, 1:]), np.minimum(pad[:-1, 1:-1], pad[1:, 1:-1])
    for t in np.unique(f):
        euler = (corner <= t).sum() - (across <= t).sum() - (down <= t).sum() + (f <= t).sum()
        alive = sum((1 if k == 0 else -1) for k, b, d, *_ in points if b <= t < d)
        assert euler == alive + 1


def test_many_fields_at_once_give_what_each_gives_alone():
    f = np.round(np.random.default_rng(3).random((5, 9, 6)), 1)
    got = persistence.diagrams_of(f)
    for i in range(5):
        mine = got["tile"] == i
        assert sorted(zip(got["dim"][mine], got["birth"][mine], got["death"][mine], strict=True)) == sorted((k, b, d) for k, b, d, *_ in persistence.diagram(f[i]))


def test_field_arrays_are_the_columns(spark):
    rng = np.random.default_rng(4)
    px = rng.integers(0, 256, (20, 3))
    rows = spark.createDataFrame([(i, *map(int, p)) for i, p in enumerate(px)], "i int, r int, g int, b int")
    own = {"mine": (0.3, 0.6, 0.7)}
    for spec, how in (("gray", "max"), ("hematoxylin", "max"), ("hematoxylin/eosin", "max"), ("dab+mine", "max"), ("dab+mine", "sum"), ("dab+mine", "mean")):
        want = [r["v"] for r in rows.orderBy("i").select(optics.field(spec, how, own).alias("v")).collect()]
        assert np.allclose(optics.field_array(spec, px.astype(float), how, own), want)
    with pytest.raises(ValueError):
        optics.field_array("nothing", px.astype(float))


def test_places_sums_and_percentiles_of_groups(spark):
    rng = np.random.default_rng(5)
    data = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 400), np.round(rng.random(400), 2), strict=True)] + [(9, 0.5)] * 3
    rows = spark.createDataFrame(data, "g int, v double")
    by = {g: sorted(v for h, v in data if h == g) for g in {g for g, _ in data}}
    got = {}
    for r in ordering.ranked(rows, ["v"], "at", ["g"]).collect():
        got.setdefault(r["g"], []).append((r["at"], r["v"]))
    assert {g: [v for _, v in sorted(x)] for g, x in got.items()} == by
    assert all(sorted(a for a, _ in x) == list(range(len(x))) for x in got.values())
    assert sorted(r["at"] for r in ordering.ranked(rows, ["v"], "at").collect()) == list(range(len(data)))
    one = rows.distinct()
    for r in ordering.running(one, ["g"], ["v"], F.lit(1), "before").collect():
        assert r["before"] == sum(v < r["v"] for v in set(by[r["g"]]))
    for r in ordering.percentiles(rows, ["g"], "v", [0.0, 0.01, 0.37, 1.0], 0.0, 1.0, bins=7).collect():
        assert np.allclose(r["p"], np.percentile(by[r["g"]], [0, 1, 37, 100]))
    assert ordering.ranked(rows.limit(0), ["v"], "at", ["g"]).count() == 0


def test_crops_are_the_bytes_of_their_place(spark):
    image = np.arange(6 * 5 * 3, dtype=np.uint8).reshape(6, 5, 3)
    rows = spark.createDataFrame([("a", 6, 5, image.tobytes()), ("small", 2, 2, bytes(12))], "name string, h int, w int, rgb binary")
    got = {(r["top"], r["left"]): bytes(r["rgb"]) for r in tiling.cropped(rows, 3, 1).collect()}
    assert set(got) == {(y, x) for y in (0, 2) for x in (0, 2)}
    assert all(v == image[y : y + 3, x : x + 3].tobytes() for (y, x), v in got.items())


def test_ingest_writes_tiles_with_tissue(spark, tmp_path):
    dark, white = bytes([100]) * 48, bytes([250]) * 48
    both = np.concatenate([np.frombuffer(x, np.uint8).reshape(4, 4, 3) for x in (dark, white)], 1)
    rows = [("o1", "s1.png", 4, 8, both.tobytes(), True, "trainA"), ("o2", "s2.png", -1, -1, None, False, "trainA")]
    src = spark.createDataFrame(rows, "origin string, name string, h int, w int, rgb binary, valid boolean, split string")
    got = jobs.ingest_tiles(src, "ER", str(tmp_path / "t"), 4, resize_to=2, tissue_threshold=0.5).collect()
    assert [(r["split"], r["images"], r["written"], r["skipped"]) for r in got] == [("trainA", 2, 1, 1)]
    tile = spark.read.parquet(str(tmp_path / "t")).where("marker = 'ER' AND split = 'train' AND domain = 'A'").first()
    assert (tile["stem"], tile["h"], tile["w"], bytes(tile["rgb"])) == ("s1_r0c0", 2, 2, bytes([100]) * 12)


def test_lists_padded_in_place_are_sorted():
    rng = np.random.default_rng(6)
    for n, m in ((0, 0), (0, 4), (7, 3), (5, 5)):
        a, b = np.sort(rng.normal(size=n)), np.sort(rng.normal(size=m))
        x, y = (np.sort(np.concatenate([v, np.zeros(max(n, m) - len(v))])) for v in (a, b))
        assert math.isclose(sweep.padded_distance(a, b), np.abs(x - y).sum(), abs_tol=1e-12)


def stain_tiles(seed, v1, v2, domain):
    rng = np.random.default_rng(seed)
    c = rng.random((40, 40, 2)) ** 3 * np.array([1.0, 0.8])
    od = c @ np.array([optics.unit(v1), optics.unit(v2)])
    return (f"t{seed}", "ER", domain, 40, 40, np.clip(np.rint(255 * 10**-od), 0, 255).astype(np.uint8).tobytes())


def test_stains_are_recovered_and_ordered(spark):
    h, e, d = (optics.STAINS[k] for k in ("hematoxylin", "eosin", "dab"))
    rows = [stain_tiles(i, h, e, "A") for i in range(6)] + [stain_tiles(50 + i, d, h, "B") for i in range(6)]
    tiles = spark.createDataFrame(rows, "name string, marker string, domain string, h int, w int, rgb binary")
    run, table = jobs.estimate_stains(tiles, pixels=900, limit=5)
    r = run.first()
    off = lambda a, b: math.degrees(math.acos(min(1.0, float(np.dot(a, optics.unit(b))))))
    assert off(r["a1"], h) < 4 and off(r["a2"], e) < 4 and off(r["b1"], h) < 4 and off(r["b2"], d) < 4 and r["warnings"] == []
    assert {x["domain"] for x in table.collect()} == {"A", "B"}
    pinned, _ = jobs.estimate_stains(tiles, pixels=900, limit=5, pin=True)
    p = pinned.first()
    assert p["b1"] == p["a1"] and p["shared_angle"] < 1e-3 and "replaced" in p["warnings"][0]
    with pytest.raises(ValueError, match="stained pixels"):
        jobs.estimate_stains(tiles, pixels=20, limit=5)


def test_ties_of_settings_go_by_their_number(spark):
    rows = [("ER", "fixed", "strict", i, f, "g", k, "0", "auto", a) for i, f, k, a in ((0, "z", 1, 0.7), (1, "a", 1, 0.7), (2, "b", 2, 0.695), (3, "c", 2, 0.695))]
    s = spark.createDataFrame(rows, "marker string, vectors string, control string, combo_no int, field_a string, field_b string, downsample int, dims string, projection string, auroc double")
    assert [r["field_a"] for r in scoring.top_candidates(s).orderBy("place").collect()] == ["z", "a", "b", "c"]
    assert [r["field_a"] for r in scoring.cheapest(s, ["marker"]).orderBy("combo_no").collect()] == ["z", "b"]


def test_errors_where_nothing_can_be_compared(spark):
    t = spark.createDataFrame([("ER", "A", "s1", "x"), ("ER", "B", "s2", "y")], "marker string, domain string, slide string, stem string")
    with pytest.raises(ValueError, match="no source"):
        pairing.holdout(t, 0.1, 7)
    with pytest.raises(ValueError):
        pairing.sampled(t, 7, sample="first")
    with pytest.raises(ValueError):
        persistence.projected_lists(F.col("d"), "height", 0)
    a, b = (spark.sql(f"SELECT {t} AS tile, struct(array(1D) AS p0, array(2D) AS p1) AS {n}") for t, n in ((1, "a"), (2, "b")))
    with pytest.raises(ValueError, match="partner"):
        reports.paired_loss(a, b, "tile")
    costs = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 1, 2.0)], "batch int, i int, j int, cost double")
    reports.MOST_COSTS, was = 1, reports.MOST_COSTS
    try:
        with pytest.raises(ValueError, match="costs"):
            reports.matched_loss(costs, "batch", "i", "j")
    finally:
        reports.MOST_COSTS = was


def test_auroc_counts_ties_half(spark):
    rows = spark.createDataFrame([(1, False, 1.0), (1, True, 2.0), (1, True, 1.0), (2, False, 3.0), (2, True, 1.0)], "k int, w boolean, v double")
    got = {r["k"]: r["auroc"] for r in scoring.auroc(rows, ["k"], "v", "w").collect()}
    assert got == {1: 0.75, 2: 0.0}


def test_distance_pads_and_then_sorts(spark):
    rows = spark.sql("SELECT struct(array(-1.0D, -3.0D) AS p0) AS a, struct(array(-2.0D) AS p0) AS b")
    assert rows.select(persistence.distance("a", "b", (0,)).alias("d")).first()["d"] == 2.0  # [-3, -1] with [-2, 0]


def test_assignment_is_the_best():
    from itertools import permutations

    c = np.random.default_rng(1).random((4, 6))
    best = min(sum(c[i, p[i]] for i in range(4)) for p in permutations(range(6), 4))
    assert math.isclose(sum(c[i, j] for i, j in persistence.assignment(c)), best)
    assert len(persistence.assignment(c.T)) == 4


def test_support_needs_enough_tiles(spark):
    rows = spark.createDataFrame([("a", 0.60, 512), ("b", 0.52, 512), ("c", 1.0, 4)], "marker string, confirm_auroc double, n_tiles long")
    # five candidates in each marker, as many as the figures are for
    rows = rows.selectExpr("*", "explode(sequence(1, 5)) AS place")
    rows = rows.selectExpr("*", "'x' AS vectors", "'g' AS field_a", "'g' AS field_b", "1 AS downsample", "'0' AS dims", "'auto' AS projection")
    got = {r["marker"]: r["supported"] for r in scoring.decided(rows).collect()}
    assert got == {"a": True, "b": False, "c": False}


def test_resampling_keeps_a_flat_image(spark):
    df = spark.createDataFrame([(8, 8, bytes([180]) * 192)], "h int, w int, rgb binary")
    assert bytes(tiling.resized(df, 4).first()["rgb"]) == bytes([180]) * 48


def test_unknown_stain_and_presets():
    with pytest.raises(ValueError):
        optics.field("hematoxylin/nothing")
    assert optics.preset("he-ihc", field_B="gray")["field_B"] == "gray"
    assert optics.split_specs("a+b") == ("a/b", "b/a")


def png(rows):
    """A PNG of rows of (r, g, b)."""
    chunk = lambda k, x: struct.pack(">I", len(x)) + k + x + struct.pack(">I", zlib.crc32(k + x))
    raw = b"".join(b"\0" + bytes(v for p in r for v in p) for r in rows)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images_splits_and_corrupt_files(spark, tmp_path):
    folder = tmp_path / "HE" / "train"
    folder.mkdir(parents=True)
    (folder / "a.PNG").write_bytes(png([[(10, 20, 30), (40, 50, 60)]]))
    (folder / "b.png").write_bytes(b"no image")
    (folder / "c.txt").write_bytes(b"text")
    got = images.images(spark, str(tmp_path))
    rows = {r["name"]: r for r in images.with_split(got, str(tmp_path), ["HE/train:trainA"]).collect()}
    assert {k: (r["split"], r["valid"]) for k, r in rows.items()} == {"a.PNG": ("trainA", True), "b.png": ("trainA", False)}
    assert bytes(rows["a.PNG"]["rgb"]) == bytes([10, 20, 30, 40, 50, 60]) and rows["b.png"]["rgb"] is None
    crops = got.where("valid").selectExpr("origin", "true AS kept")
    assert sorted((r["written"], r["skipped"]) for r in images.tiling_counts(crops, got, "kept").collect()) == [(0, 0), (1, 0)]


def test_vectors_and_scores_are_read_as_written(spark, tmp_path):
    v = spark.createDataFrame([("ER", "fixed", "A", [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], 90.0), ("ER", "fixed", "B", [1.0, 0.0, 0.0], None, None)], images.VECTORS)
    images.write_vectors(v, str(tmp_path / "v"))
    assert [r["domain"] for r in images.read_vectors(spark, str(tmp_path / "v")).collect()] == ["A"]
    s = spark.createDataFrame([("ER", "fixed", "strict", "screen", 0.6, 7, None)], "marker string, vectors string, control string, stage string, auroc double, seed int, slide_regex string")
    for rows in (s, s, s.withColumn("seed", F.lit(8)), s.withColumn("slide_regex", F.lit("x")), s):  # a run that is written again replaces itself alone
        images.append_scores(rows, str(tmp_path / "s"))
    got = spark.read.parquet(str(tmp_path / "s")).where("marker = 'ER' AND stage = 'screen'").collect()
    assert sorted((r["seed"], str(r["slide_regex"])) for r in got) == [(7, "None"), (7, "x"), (8, "None")]


def test_matched_loss_is_the_best_assignment(spark):
    from itertools import permutations

    c = np.random.default_rng(2).random((3, 4))
    rows = spark.createDataFrame([(1, i, j, float(c[i, j])) for i in range(3) for j in range(4)], "batch int, i int, j int, cost double")
    got = reports.matched_loss(rows, "batch", "i", "j").first()
    best = min(sum(c[i, p[i]] for i in range(3)) for p in permutations(range(4), 3))
    assert got["matched"] == 3 and math.isclose(got["sum_loss"], best) and math.isclose(got["mean_loss"], best / 3)


def test_topology_report_leaves_out_incomplete_tiles(spark):
    rows = [(1, r, [1.0 if r == "real_A" else 3.0], [0.0]) for r in reports.ROLES] + [(2, "real_A", [9.0], [9.0])]
    got = reports.topology_report(spark.createDataFrame(rows, "tile int, role string, p0 array<double>, p1 array<double>").selectExpr("'x' AS run", "*"), ["run"]).first()
    assert (got["cyc_h"], got["cyc_i"], got["trans_h"], got["trans_i"], got["n_tiles"], got["incomplete"], got["total"]) == (2.0, 0.0, 2.0, 0.0, 1, 1, 4.0)


def test_pixels_of_one_grey_level_make_no_points():
    field = np.zeros((1, 4, 4, 3))
    field[:] = (129, 87, 136)
    field[0, 1, 1] = field[0, 2, 3] = (133, 77, 177)  # the same grey level in whole numbers: 299 r + 587 g + 114 b
    assert len(np.unique(optics.field_array("gray", field))) == 1
    assert len(persistence.diagrams_of(-optics.field_array("gray", field))["birth"]) == 0
    # averages of 3 x 3 pixels with the same sums of colours in another order
    ninth = lambda k: np.tile(np.array([[129, 87, 136]] * 9 + [[133, 77, 177]] * 9, float)[k : k + 9].mean(0), (3, 1))
    assert len(np.unique(optics.field_array("gray", np.concatenate([ninth(k) for k in range(10)])))) == 1
    # pixels of one colour, wherever they stand
    for spec in ("hematoxylin", "hematoxylin/eosin", "dab+hematoxylin"):
        assert len(np.unique(optics.field_array(spec, np.tile(np.array([129.0, 87, 136]), (1, 37, 29, 1))))) == 1


def test_second_vector_of_a_plane_is_accurate_where_values_are_close(spark):
    """Two small eigenvalues 2e-7 apart: the closed form with an arc cosine is off by some 1e-5 there, so it is no yardstick."""
    q = np.linalg.qr(np.array([[1.0, 0.3, 1.0], [1.0, -2.0, 0.1], [1.0, 0.5, -1.2]]))[0]
    m = q @ np.diag([0.3, 2e-3 + 2e-7, 2e-3]) @ q.T
    row = spark.createDataFrame([(1, 100, *(float(m[i, j]) for i in range(3) for j in range(i, 3)))], "k int, n long, m00 double, m01 double, m02 double, m11 double, m12 double, m22 double")
    got = np.array(stains.plane(row, ["k"]).first()["e2"])
    assert min(np.abs(got - q[:, 1]).max(), np.abs(got + q[:, 1]).max()) < 1e-8


def test_pixels_are_dealt_by_tile_before_they_are_sorted(spark):
    rows = spark.range(1).selectExpr("explode(sequence(0, 99)) AS p").selectExpr("p % 4 AS tile", "p AS y", "0 AS x")
    got = stains.sampled_pixels(rows, ["tile"], 3, 1)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("Exchange") > plan.rindex("Sort [")  # the deepest of them comes last
    assert got.count() == 12


def test_a_worker_gets_few_tiles_at_a_time(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")}
    rows = spark.range(0, 1500, 1, 1).selectExpr("'A' AS domain", "1 AS h", "1 AS w", "unhex('010203') AS rgb")
    for made in (
        lambda: tiling.measured(rows, "n", "int", pa.int32(), lambda x: [len(x)] * len(x)),
        lambda: persistence.tile_diagrams(rows, {"A": ["gray"]}, [1]),
        lambda: tiling.cropped(rows, 1),
        lambda: stains.tile_pixels(rows.withColumn("name", F.lit("a")), ["domain"]),
        lambda: sweep.setting_distances(spark.range(1).selectExpr("null AS a", "null AS b"), "a", "b", []),
    ):
        for k in was:
            spark.conf.set(k, str((1 << 31) - 1) if "Bytes" in k else "10000")
        df = made()
        assert all(int(spark.conf.get(k)) <= most for k, most in zip(was, (tiling.ARROW_ROWS, tiling.ARROW_BYTES), strict=True))
        if "n" in df.columns:
            assert max(r.n for r in df.select("n").collect()) <= tiling.ARROW_ROWS
    for k, v in was.items():
        spark.conf.set(k, v)


def test_large_fields_take_bounded_memory():
    """Some 90 bytes a pixel of noise in numpy; 220 with eight-byte places and passes of the whole field at once."""
    import tracemalloc

    field = np.random.default_rng(0).random((1, 700, 700))
    tracemalloc.start()
    got = persistence.diagrams_of(field)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got["birth"]) > 100_000 and peak < 110 * field.size


def test_strips_give_the_field_of_the_whole():
    images = np.random.default_rng(1).integers(0, 256, (2, 1003, 401, 3)).astype(np.uint8)
    for k in (1, 3):
        for spec in ("gray", "hematoxylin/eosin"):
            make = lambda x: optics.field_array(spec, x)  # noqa: B023, E731
            assert np.array_equal(tiling.by_strips(images, k, make), make(tiling.pooled(images, k)))
    assert tiling.by_strips(images[:, :2], 3, lambda x: x[..., 0]).shape == (2, 0, 133)
