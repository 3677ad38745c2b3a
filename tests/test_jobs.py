"""Jobs from end to end: second runs, slices and vectors by marker, registration of case folders, inference."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_tiles import png, stain_tiles

from mosaica.functions import optics
from mosaica.operators import persistence, registration, sweep, tiling
from mosaica.plans import jobs
from mosaica.sources import images

TILES = "marker string, domain string, stem string, name string, h int, w int, rgb binary"


def paired_tiles(spark, sizes, side=8, seed=0):
    """For each marker so many pairs of tiles, four to a slide; B's are A's with noise."""
    rng, rows = np.random.default_rng(seed), []
    for m, n in sizes.items():
        for i in range(n):
            a = rng.integers(20, 230, (side, side, 3))
            stem = f"{m.lower()}{i // 4:03d}_r{i % 4 // 2}c{i % 2}"
            for d, x in (("A", a), ("B", np.clip(a + rng.integers(-25, 25, a.shape), 1, 254))):
                rows.append((m, d, stem, stem + ".png", side, side, x.astype(np.uint8).tobytes()))
    return spark.createDataFrame(rows, TILES)


def table(spark, by):
    return spark.createDataFrame([(m, "own", d, list(optics.unit(a)), list(optics.unit(b)), 0.0) for (m, d), (a, b) in by.items()], images.VECTORS)


H, E, D = (optics.STAINS[n] for n in ("hematoxylin", "eosin", "dab"))


def test_ingest_run_again_changes_nothing(spark, tmp_path):
    rng = np.random.default_rng(1)
    dark, white = bytes([100]) * 192, bytes([250]) * 192
    both = np.concatenate([np.frombuffer(x, np.uint8).reshape(8, 8, 3) for x in (dark, white)], 1).tobytes()
    rows = [("o1", "s1.png", 8, 16, both, True, "trainA"), ("o2", "s2.png", 16, 16, rng.integers(0, 200, 768, np.uint8).tobytes(), True, "trainB"), ("o3", "s3.png", -1, -1, None, False, "trainB")]
    src, out = spark.createDataFrame(rows, "origin string, name string, h int, w int, rgb binary, valid boolean, split string"), str(tmp_path / "t")
    counts = lambda **k: sorted((r["split"], r["images"], r["written"], r["skipped"]) for r in jobs.ingest_tiles(src, "ER", out, tissue_threshold=0.5, **k).collect())
    want = [("trainA", 1, 1, 1), ("trainB", 2, 4, 0)]
    assert counts(size=8) == counts(size=8) == want and spark.read.parquet(out).count() == 5
    # a run that was cut short is taken up again; one with an other size stands beside it
    short = str(tmp_path / "u")
    jobs.ingest_tiles(src.where("origin = 'o1'"), "ER", short, 8, tissue_threshold=0.5).collect()
    assert sorted((r["split"], r["written"]) for r in jobs.ingest_tiles(src, "ER", short, 8, tissue_threshold=0.5).collect()) == [("trainA", 1), ("trainB", 4)]
    assert counts(size=16) == [("trainA", 1, 0, 0), ("trainB", 2, 1, 0)] and counts(size=8) == want and spark.read.parquet(out).count() == 6


def test_audit_halves_each_markers_own_pairs(spark, tmp_path):
    tiles = paired_tiles(spark, {"ER": 10, "PR": 40})
    grid = sweep.settings(["gray"], ["gray"], [1, 2], ["0"], ["auto"])
    got = jobs.audit(tiles, {"fixed": (grid, None)}, seed=3, scores_path=str(tmp_path / "s"))
    for k, name in ((0, "screen"), (1, "second")):
        assert {(r["marker"], r["n_pairs"], r["offset"], r["limit"]) for r in got[name].collect()} == {("ER", 5, 5 * k, 5), ("PR", 20, 20 * k, 20)}
    assert {r["marker"] for r in got["verdicts"].collect()} == {"ER", "PR"}
    before = spark.read.parquet(str(tmp_path / "s")).count()
    jobs.audit(tiles, {"fixed": (grid, None)}, seed=3, scores_path=str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == before == 2 * 2 * 2 + 2 * 2
    fixed = jobs.audit(paired_tiles(spark, {"ER": 12, "PR": 14}), {"fixed": (grid, None)}, seed=3, limit=6)
    assert {(r["marker"], r["n_pairs"]) for r in fixed["screen"].collect()} == {("ER", 6), ("PR", 6)}


def test_vectors_by_marker_are_those_of_each_marker_alone(spark):
    tiles = paired_tiles(spark, {"ER": 8, "PR": 8})
    by = {("ER", "A"): (H, E), ("ER", "B"): (D, H), ("PR", "A"): (E, D), ("PR", "B"): (H, D)}
    chosen = sweep.settings(["stain1/stain2"], ["stain1+stain2"], [1], ["0", "1"], ["auto"])
    together = {(r["marker"], r["dims"]): r for r in sweep.score_fields(tiles, chosen, vectors=table(spark, by), shuffles=4).collect()}
    for m in ("ER", "PR"):
        own = {d: {"stain1": by[m, d][0], "stain2": by[m, d][1]} for d in "AB"}
        for r in sweep.score_fields(tiles.where(F.col("marker") == m), chosen, vectors=own, shuffles=4).collect():
            t = together[m, r["dims"]]
            assert np.isclose(t["true_mean"], r["true_mean"]) and np.isclose(t["wrong_mean"], r["wrong_mean"]) and np.isclose(t["auroc"], r["auroc"])
            assert (t["sample"], t["slide_regex"], t["image_size"], t["invert"], t["groups"], t["limit"]) == ("random", r"_r\d+c\d+$", 0, True, 2, 0)
    assert not np.isclose(together["ER", "0"]["true_mean"], together["PR", "0"]["true_mean"])
    with pytest.raises(ValueError, match="no stain vectors for PR"):
        sweep.score_fields(tiles, chosen, vectors=table(spark, {k: v for k, v in by.items() if k[0] == "ER"}))
    with pytest.raises(ValueError, match="several stain vectors"):
        sweep.score_fields(tiles, chosen, vectors=table(spark, by).unionByName(table(spark, by)))
    with pytest.raises(Exception, match="unknown stain"):
        sweep.score_fields(tiles, chosen)
    # names of the literature need no table
    named = sweep.settings(["hematoxylin/eosin"], ["gray"], [1], ["0"], ["auto"])
    assert sweep.score_fields(tiles, named, vectors=table(spark, {("ER", "A"): (H, E)})).count() == 2


def test_a_marker_without_partners_or_pairs_is_an_error(spark):
    tiles = paired_tiles(spark, {"ER": 8, "PR": 1})
    chosen = sweep.settings(["gray"], ["gray"], [1], ["0"], ["auto"])
    with pytest.raises(ValueError, match="'PR' has another partner"):
        sweep.score_fields(tiles, chosen)
    with pytest.raises(ValueError, match="no tiles to compare for 'PR'"):
        sweep.score_fields(tiles.where("marker = 'ER' OR domain = 'A'"), chosen)
    with pytest.raises(ValueError, match="no tiles to compare"):
        jobs.audit(tiles.where("marker = 'ER' OR domain = 'A'"), {"fixed": (chosen, None)})


def test_each_two_tiles_are_compared_once(spark, monkeypatch):
    tiles = paired_tiles(spark, {"ER": 12})
    chosen = sweep.settings(["gray"], ["gray"], [1], ["0,1"], ["auto"])
    seen, was = [], sweep.setting_distances
    monkeypatch.setattr(sweep, "setting_distances", lambda pairs, *a: seen.append(pairs.count()) or was(pairs, *a))
    row = sweep.score_fields(tiles, chosen, shuffles=20).first()
    assert row["n_wrong"] == 240 and row["n_tiles"] == 12 and seen == [12 + 12 * 3]  # a slide has four tiles
    # the same score from every pair of every shuffle by itself
    pairs = sweep.sampled_pairs(tiles)
    made = sweep.pair_diagrams(tiles, pairs, chosen)
    from mosaica.operators import pairing, scoring

    wrong = pairing.strict_partners(pairs, 0, 20).withColumn("wrong", F.lit(True))
    true = wrong.where("shuffle_no = 0").withColumns({"partner_idx": F.col("pair_idx"), "wrong": F.lit(False)})
    long = was(sweep.paired_diagrams(pairs, made, wrong.unionByName(true)), "a", "b", chosen).select("wrong", F.col("distances")[0].alias("d"))
    plain = scoring.score_rows(long.withColumn("k", F.lit(1)), ["k"], "d", "wrong").first()
    assert all(np.isclose(row[c], plain[c]) for c in ("true_mean", "wrong_mean", "auroc", "auroc_se", "ratio"))


def test_tiles_of_any_size_are_scored_like_their_resized_copies(spark):
    small, large = paired_tiles(spark, {"ER": 8}, 8), paired_tiles(spark, {"PR": 8}, 11, 1)
    mixed = small.unionByName(large)
    copies = tiling.resized(mixed, 16, tiling.bilinear)
    chosen = sweep.settings(["gray", "hematoxylin/eosin"], ["gray"], [1, 2], ["0,1"], ["auto"])
    score = lambda t, **k: sorted((r["marker"], r["combo_no"], round(r["true_mean"], 9), round(r["auroc"], 9)) for r in sweep.score_fields(t, chosen, **k).collect())
    assert score(mixed, image_size=16) == score(copies) != score(mixed)
    assert score(copies, invert=False) != score(copies)


def test_critical_pixels_give_the_values(spark):
    f = np.round(np.random.default_rng(3).integers(0, 255, (3, 9, 7, 3)), 0).astype(np.uint8)
    rows = spark.createDataFrame([(i, "A", 9, 7, x.tobytes()) for i, x in enumerate(f)], "i int, domain string, h int, w int, rgb binary")
    for invert in (True, False):
        got = persistence.diagram_rows(persistence.tile_diagrams(rows, {"A": ["gray"]}, [2], places=True, invert=invert), ["i"], places=True).collect()
        field = optics.field_array("gray", tiling.pooled(f, 2)) * (-1 if invert else 1)
        assert got and all(field[r["i"], r["birth_y"], r["birth_x"]] == r["birth"] and field[r["i"], r["death_y"], r["death_x"]] == r["death"] for r in got)


def test_estimate_and_score_keeps_the_splits_apart(spark):
    rows = []
    for i in range(24):
        for d, v in (("A", (H, E)), ("B", (D, H))):
            *_, h, w, rgb = stain_tiles(100 * (d == "B") + i, *v, d)
            rows.append(("ER", d, f"s{i // 4:02d}_r{i % 4 // 2}c{i % 2}", f"t{i}", h, w, rgb))
    tiles = spark.createDataFrame(rows, TILES)
    train, val = tiles.where("stem < 's03'"), tiles.where("stem >= 's03'")
    got = jobs.estimate_and_score(train, val, sweep.settings(["stain1/stain2", "stain2/stain1"], ["stain2/stain1"], [2], ["0"], ["auto"]), estimate={"pixels": 400, "limit": 0}, shuffles=2)
    assert {(r["marker"], r["vectors"], r["n_pairs"]) for r in got["scores"].collect()} == {("ER", "estimated", 12)}
    off = lambda a, b: np.degrees(np.arccos(min(1.0, float(np.dot(a, optics.unit(b))))))
    v = {r["domain"]: r for r in got["vectors"].collect()}
    assert off(v["A"]["stain1"], H) < 4 and off(v["B"]["stain1"], H) < 4 and off(v["B"]["stain2"], D) < 4
    with pytest.raises(ValueError, match="is in both splits"):
        jobs.estimate_and_score(train, val.unionByName(train.limit(1)))
    # vectors that were learnt elsewhere are no help for a marker that training lacks
    with pytest.raises(ValueError, match="no stain vectors for PR"):
        jobs.estimate_and_score(train, val.unionByName(val.withColumn("marker", F.lit("PR"))), estimate={"pixels": 400, "limit": 0})


def test_inspected_pairs_may_have_vectors_of_their_own(spark):
    tiles = spark.createDataFrame([("ER", d, f"s0_r0c{i}", f"t{i}", *stain_tiles(10 * i + (d == "B"), *v, d)[3:]) for i in range(2) for d, v in (("A", (H, E)), ("B", (D, H)))], TILES)
    got = jobs.inspect_pairs(tiles, "stain1/stain2", "stain1+stain2", 5, vectors="pair", least=300, downsample=4)
    off = lambda a, b: np.degrees(np.arccos(min(1.0, float(np.dot(a, optics.unit(b))))))
    v = {(r["pair_idx"], r["domain"]): r for r in got["vectors"].collect()}
    assert len(v) == 4 and all(off(r["stain1"], H) < 5 for r in v.values()) and off(v[0, "A"]["stain2"], E) < 5 and off(v[0, "B"]["stain2"], D) < 5
    assert {r["channel"] for r in got["channels"].collect()} == {"stain1/stain2", "stain2/stain1", "stain1+stain2"}
    again = jobs.inspect_pairs(tiles, "stain1/stain2", "stain1+stain2", 5, vectors=table(spark, {("ER", "A"): (H, E), ("ER", "B"): (H, D)}), downsample=4)
    fixed = jobs.inspect_pairs(tiles, "stain1/stain2", "stain1+stain2", 5, vectors={"A": {"stain1": H, "stain2": E}, "B": {"stain1": H, "stain2": D}}, downsample=4)
    for name in ("distances", "diagrams"):
        a, b = (sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in x[name].collect()) for x in (again, fixed))
        assert a == b
    assert {"birth_y", "death_x"} <= set(got["diagrams"].columns)


def test_inference_takes_batches_and_runs_nothing_twice(spark, tmp_path):
    tiles, calls, out = paired_tiles(spark, {"ER": 10, "PR": 6}), tmp_path / "calls", str(tmp_path / "out")
    calls.mkdir()

    def make():
        import os
        import uuid

        def model(x):
            assert x.shape[1] == 3 * 16 and x.min() >= -1 and x.max() <= 1
            (calls / f"{uuid.uuid4().hex}-{len(x)}-{os.getpid()}").touch()
            return 0.5 * x

        return model

    run = lambda **k: jobs.infer_tiles(tiles.repartition(1), out, make, size=4, batch=4, **k).count()
    held = lambda: [int(p.name.split("-")[1]) for p in calls.iterdir()]
    assert run(limit=5) == 5 and sorted(held()) == [1, 4]
    assert run() == 11 and sum(held()) == 16 and max(held()) == 4
    before = len(held())
    assert run() == 0 and len(held()) == before
    assert run(direction="B2A", limit=3) == 3
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 19 and all(len(r["out"]) == 48 and 0.25 <= min(r["out"]) and max(r["out"]) <= 0.75 for r in rows)
    x = tiling.loaded(tiles.where("domain = 'A' AND stem = 'er000_r0c0'"), 4).first()["x"]
    mine = next(r for r in rows if r["stem"] == "er000_r0c0" and r["direction"] == "A2B")
    assert np.allclose(mine["out"], (0.5 * np.array(x) + 1) / 2)
    with pytest.raises(ValueError, match="direction"):
        jobs.infer_tiles(tiles, out, make, "A2C")
    nothing = tiling.translate(spark.createDataFrame([(None,), ([1.0, -1.0],)], "x array<double>"), "x", lambda: lambda x: x, 2).collect()
    assert nothing[0]["out"] is None and nothing[1]["out"] == [1.0, 0.0]


def case_folders(root):
    """Four folders of cases with small images: c1 is placed in both domains, c2 in one, c3's file is bad, c4 is in one domain only."""
    rng = np.random.default_rng(4)
    pixels = lambda level: [[tuple(int(v) for v in rng.integers(level - 20, level, 3)) for _ in range(6)] for _ in range(6)]

    def put(folder, case, ids, blank=(), broken=()):
        d = root / folder / case / "images"
        d.mkdir(parents=True)
        for i in ids:
            (d / f"{i}.png").write_bytes(b"broken" if i in broken else png(pixels(255 if i in blank else 120)))

    def place(folder, case, lines, header="tile_name,x,y,tile_size"):
        (root / folder / case / "tiles_metadata.csv").write_text("\n".join([header, *lines]) + "\n")

    put("valA", "c1", ["1", "2", "3", "4", "5"], blank=["4"], broken=["5"])
    put("valB", "c1", ["11", "12", "13", "14", "15", "16"])
    place("valA", "c1", ["1,0,0,6", "2,6,0,6", "3,0,6,6", "4,6,6,6", "5,12,0,6", "9,18,0,6"])
    # columns in an other order and more of them; 16 was read last at the place of 12; 19 has no image
    place("valB", "c1", ["0,6,11,0,z", "6,6,12,0,z", "0,6,13,6,z", "6,6,14,6,z", "12,6,15,0,z", "6,6,16,0,z", "18,6,19,0,z"], "x,tile_size,tile_name,y,note")
    put("valA", "c2", ["1", "2"])
    put("valB", "c2", ["2", "3"])
    place("valA", "c2", ["1,0,0,6", "2,6,0,6"])
    put("valA", "c3", ["1", "2"])
    put("valB", "c3", ["1", "2"], blank=["2"])
    place("valA", "c3", ["1,0,0,6", "2,x,0,6"])
    place("valB", "c3", ["1,0,0,6", "2,6,0,6"])
    put("valA", "c4", ["1"])
    put("trainA", "c1", ["1", "2"])
    put("trainA", "t1", ["1", "2", "3"], blank=["2"])
    put("trainB", "t2", ["1"], broken=["1"])
    put("trainB", "t3", ["1", "2"])
    return {x: str(root / x) for x in ("trainA", "trainB", "valA", "valB")}


def test_case_folders_are_registered(spark, tmp_path):
    folders, out = case_folders(tmp_path), str(tmp_path / "out")
    for _ in range(2):  # a second run leaves what one does
        got = jobs.register_cases(spark, folders, out, min_tissue=0.5)
        pairs = sorted((r["case_id"], r["id_a"], r["id_b"], r["how"], r["name"]) for r in got["pairs"].collect())
        assert pairs == [("c1", "1", "11", "coordinate", "c1_0_0_r0c0"), ("c1", "2", "16", "coordinate", "c1_0_0_r0c1"), ("c1", "3", "13", "coordinate", "c1_0_0_r1c0"), ("c2", "2", "2", "id", "c2_2"), ("c3", "1", "1", "id", "c3_1")]
        report = {r["case_id"]: (r["tiles_a"], r["tiles_b"], r["paired"]) for r in got["report"].collect()}
        assert report == {"c1": (5, 6, 5), "c2": (2, 2, 1), "c3": (2, 2, 2)}
        assert [tuple(r) for r in got["overlap"].collect()] == [("c1", False)]
        counts = {r["split"] + r["domain"]: r["tiles"] for r in got["counts"].collect()}
        assert counts == {"trainA": 4, "trainB": 2, "valA": 5, "valB": 5}
        assert [(r["kept"], r["per_slice"]) for r in got["power"].collect()] == [(5, 2)]
        written = {(r["split"], r["domain"], r["stem"]) for r in spark.read.parquet(out).collect()}
        assert spark.read.parquet(out).count() == 16 == len(written) and ("val", "B", "c1_0_0_r0c1") in written and ("train", "A", "t1_3") in written
        survey = got["survey"].orderBy("k").collect()
        # 5 + 3 training tiles and 16 sides of 8 pairs were looked at; two blank ones, one of a pair, and two broken files have no tissue
        assert len(survey) == 11 and survey[0]["decile"] == 0.0 and survey[0]["under_50"] == 5
    held = jobs.register_cases(spark, folders, str(tmp_path / "held"), min_tissue=0.5, exclude_val_cases=True)
    assert {r["split"] + r["domain"]: r["tiles"] for r in held["counts"].collect()}["trainA"] == 2
    with pytest.raises(ValueError, match="no tile of a case is paired"):
        jobs.register_cases(spark, folders | {"valB": folders["trainB"]}, out)


def test_files_that_place_tiles(spark):
    files = [("/r/a/tiles_metadata.csv", 'tile_name,x,y,tile_size\n"t,1",1,2,3\nt2, 4 ,5,6\nt2,7,8,9\n'), ("/r/b/tiles_metadata.csv", "tile_name,x,y\nt,1,2\n"), ("/r/c/tiles_metadata.csv", ""), ("/r/d/tiles_metadata.csv", "tile_name,x,y,tile_size\nt,1,2.5,3\n"), ("/r/e/tiles_metadata.csv", "x,y,tile_size,tile_name\r\n1,2,3,t\r\n"), ("/r/f/tiles_metadata.csv", None), ("/r/g/tiles_metadata.csv", "tile_name,x,y,tile_size\nt,1\n")]
    got = images.coordinates(spark.createDataFrame(files, "origin string, csv string")).collect()
    assert sorted(tuple(r) for r in got) == [("a", "t,1", 1, 2, 3, 0), ("a", "t2", 7, 8, 9, 1), ("e", "t", 1, 2, 3, 0)]
    none = images.coordinates(spark.createDataFrame([], "origin string, csv string"))
    index = spark.createDataFrame([(d, "c", i) for d in "AB" for i in "12"], "domain string, case_id string, id string")
    pairs = registration.registered_pairs(registration.located(none.withColumn("domain", F.lit("A")), index), "tile_size", index, "line")
    assert sorted((r["id_a"], r["how"], r["name"]) for r in pairs.collect()) == [("1", "id", "c_1"), ("2", "id", "c_2")]


def test_distances_travel_list_by_list(spark, monkeypatch):
    """No row of a score holds the whole diagrams of two tiles, and the distances are those of such rows to the last bit."""
    tiles = paired_tiles(spark, {"ER": 8})
    for dims, projections in ((["0,1"], ["auto"]), (["0", "1", "0,1"], sweep.PROJECTIONS)):
        chosen = sweep.settings(["gray", "hematoxylin/eosin"], ["gray", "dab+hematoxylin"], [1, 2], dims, projections)
        pairs = sweep.sampled_pairs(tiles)
        made = sweep.pair_diagrams(tiles, pairs, chosen)
        meeting = pairs.selectExpr("marker", "pair_idx", "(pair_idx + 1) % 8 AS partner_idx")
        key, lists = ["pair_idx", "partner_idx", "distances"], sweep.tile_lists(made, sweep.lists_needed(chosen))
        a, b = (pairs.select("marker", F.col("pair_idx").alias(i), F.col(x.lower()).alias("name")).join(lists.where(F.col("domain") == x).drop("domain"), ["marker", "name"]).drop("name") for x, i in (("A", "pair_idx"), ("B", "partner_idx")))
        plain = sweep.setting_distances(sweep.paired_diagrams(pairs, made, meeting), "a", "b", chosen, 6)
        got = sweep.setting_distances(meeting, a, b, chosen, 6)
        assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, plain.select(*key).collect())) and got.count() == 8
    monkeypatch.delattr(sweep, "paired_diagrams")
    assert sweep.score_fields(tiles, chosen[:2]).count() == 2


def test_wide_rows_are_written_and_read_few_at_a_time(spark):
    import glob

    import pyarrow.parquet as pq

    from mosaica.sources.scratch import stored

    rows = spark.range(24).coalesce(1).selectExpr("id", "transform(sequence(1, 400000), i -> rand(7)) AS v")
    path = stored(rows, wide=True).inputFiles()[0].removeprefix("file://")
    groups = [pq.ParquetFile(f).metadata for f in glob.glob(path)]
    sizes = [g.row_group(i).num_rows for g in groups for i in range(g.num_row_groups)]
    assert sum(sizes) == 24 and max(sizes) <= 8  # 3.2 MB a row; all 24 in one group before


def test_large_tiles_are_made_in_passing(spark, tmp_path, monkeypatch):
    """The pixels of a tile are not collected as a list, and come in the order of the rows' keys, whatever order the rows have."""
    from mosaica.sources import fixtures

    rng = np.random.default_rng(3)
    rows = [(int(k), int(n), int(p), int(s), float(q)) for k, n, p, s, q in zip(rng.permutation(2700), *(rng.integers(1, 99, (4, 2700))), strict=True)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double").repartition(5).write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.delattr(F, "collect_list")
    got = {(r["stem"], r["domain"]): (r["h"], r["w"], bytes(r["rgb"])) for r in fixtures.big_images(spark, str(tmp_path), 4).collect()}
    side = int((2700 // 4) ** 0.5)
    for t in range(4):
        a = [(1 + p * 7 % 200, 1 + (s * 13 + p) % 200, 1 + (int(q) * 3 + p) % 200) for k, _, p, s, q in sorted(rows) if k % 4 == t][: side * side]
        b = [tuple((3 * c[i] + c[i - 1]) // 4 for i in range(3)) for c in a]
        for domain, pixels in (("A", a), ("B", b)):
            assert got.pop((f"s000000_r{t // 2}c{t % 2}", domain)) == (side, side, bytes(v for c in pixels for v in c))
    assert not got
