"""AUROC of true against wrong pairs, and the rule that picks settings."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mosaica.functions.optics import auroc_se, null_se
from mosaica.operators.ordering import running

SETTING = ["field_a", "field_b", "downsample", "dims", "projection"]
TOP_K, ALPHA, CHANCE = 5, 0.05, 0.5
#: Candidates of a marker for which the bar is known (TOP_K for each source of vectors).
MOST_CANDIDATES = 1000


def auroc(rows: DataFrame, keys: list[str], value: str, wrong: str) -> DataFrame:
    """keys, auroc, n_true, n_wrong: how often a true pair's value is below a wrong one's, ties counting half.

    Values are counted first, so the running sum sees distinct values only and no pairs are made.
    """
    return weighted_auroc(rows, keys, value, (~F.col(wrong)).cast("long"), F.col(wrong).cast("long"))


def weighted_auroc(rows: DataFrame, keys: list[str], value: str, true: Column, wrong: Column) -> DataFrame:
    """auroc() of rows that stand for `true` true and `wrong` wrong pairs each (whole numbers)."""
    counts = rows.groupBy(*keys, value).agg(F.sum(true).alias("t"), F.sum(wrong).alias("w"))
    summed = running(counts, keys, [F.desc(value)], F.col("w"), "above")
    got = summed.groupBy(*keys).agg(F.sum(F.col("t") * (F.col("above") + F.col("w") / 2)).alias("u"), F.sum("t").alias("n_true"), F.sum("w").alias("n_wrong"))
    return got.select(*keys, (F.col("u") / F.nullif(F.col("n_true") * F.col("n_wrong"), F.lit(0))).alias("auroc"), "n_true", "n_wrong")


def score_rows(rows: DataFrame, keys: list[str], value: str, wrong: str) -> DataFrame:
    """The score of each combination: means, their ratio (infinite if the true mean is 0), AUROC and its error at the number of true pairs."""
    return weighted_scores(rows, keys, value, (~F.col(wrong)).cast("long"), F.col(wrong).cast("long"))


def weighted_scores(rows: DataFrame, keys: list[str], value: str, true: Column, wrong: Column) -> DataFrame:
    """score_rows() of rows that stand for `true` true and `wrong` wrong pairs each (whole numbers), as where a pair comes up in several shuffles."""
    mean = lambda w: F.sum(F.col(value) * w) / F.nullif(F.sum(w), F.lit(0))
    means = rows.groupBy(*keys).agg(mean(true).alias("true_mean"), mean(wrong).alias("wrong_mean"))
    ratio = F.when(F.col("true_mean") == 0, F.lit(float("inf"))).otherwise(F.col("wrong_mean") / F.nullif("true_mean", F.lit(0.0)))
    n = F.col("n_true")
    return means.join(weighted_auroc(rows, keys, value, true, wrong), keys).withColumn("ratio", ratio).withColumn("auroc_se", auroc_se(F.col("auroc"), n, n))


def top_candidates(screen: DataFrame, k: int = TOP_K) -> DataFrame:
    """The k best strict rows of each marker and vector source: by AUROC, then coarser, then in the order of combo_no; NaN never."""
    w = Window.partitionBy("marker", "vectors").orderBy(F.desc("auroc"), F.desc("downsample"), "combo_no")  # as many rows as there are settings
    return screen.where("control = 'strict' AND NOT isnan(auroc)").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def bars(spark: SparkSession) -> DataFrame:
    """n_candidates, z_bar: the one-sided bar for so many candidates."""
    return spark.createDataFrame([(n, NormalDist().inv_cdf(1 - ALPHA / n)) for n in range(1, MOST_CANDIDATES + 1)], "n_candidates long, z_bar double")


def decided(confirmed: DataFrame) -> DataFrame:
    """confirmed (marker, vectors, place, setting, confirm_auroc, n_tiles) with the Bonferroni bar over a marker's candidates, support, and the rank in its marker.

    A supported setting outranks others; then the confirmed AUROC counts, among supported ones the coarser, then the order of vectors and place.
    """
    n = confirmed.groupBy("marker").agg(F.count(F.lit(1)).alias("n_candidates"))
    rows = confirmed.join(F.broadcast(n.join(F.broadcast(bars(confirmed.sparkSession)), "n_candidates", "left")), "marker")  # a row for each marker
    rows = rows.withColumn("z_bar", F.coalesce("z_bar", F.raise_error(F.lit(f"more than {MOST_CANDIDATES} candidates")).cast("double")))
    rows = rows.withColumn("z_observed", F.when(F.col("n_tiles") >= 2, (F.col("confirm_auroc") - CHANCE) / null_se(F.col("n_tiles"))))
    rows = rows.withColumn("supported", F.coalesce(F.col("z_observed") > F.col("z_bar"), F.lit(False)))
    w = Window.partitionBy("marker").orderBy(F.desc("supported"), F.desc("confirm_auroc"), F.desc(F.when(F.col("supported"), F.col("downsample"))), "vectors", "place")
    return rows.withColumn("rank", F.row_number().over(w))


def verdicts(rows: DataFrame) -> DataFrame:
    """The winner of each marker and what it supports."""
    verdict = F.when(F.col("supported"), "ph_trans_supported").otherwise("ph_cyc_only")
    return rows.where("rank = 1").select("marker", verdict.alias("verdict"), "vectors", *SETTING, "field_combine", "confirm_auroc")


def arms(screen: DataFrame) -> DataFrame:
    """For each marker and vector source the best strict and the best free AUROC and what the first lacks; without a strict screen there is no row."""
    best = lambda c: F.max(F.when(F.col("control") == c, F.col("auroc")))
    got = screen.groupBy("marker", "vectors").agg(best("strict").alias("best_strict"), best("unstratified").alias("best_free"))
    return got.where("best_strict is not null").withColumn("delta", F.col("best_free") - F.col("best_strict"))


def tally(rows: DataFrame) -> DataFrame:
    """Settings that are supported on more than one marker, with their markers; decided rows, one for each vector source."""
    by = rows.where("supported").groupBy(*SETTING).agg(F.array_sort(F.collect_set("marker")).alias("m"))
    return by.select(*SETTING, F.size("m").cast("long").alias("n_markers"), F.array_join("m", ",").alias("markers")).where("n_markers > 1")


def recommendation(verdict: DataFrame, overrides: DataFrame) -> DataFrame:
    """(marker, key, value): the chosen setting as rows; a value of the user counts unless it is empty.

    The literature's vectors (`fixed`) are an empty STAINS, which is a value of its own.
    """
    rows = verdict.selectExpr(
        "marker",
        """stack(8, 'FIELD_A', field_a, 'FIELD_B', field_b, 'FIELD_COMBINE', field_combine, 'TOPO_DOWNSAMPLE', CAST(downsample AS STRING), 'TOPO_DIMS', replace(dims, ',', ' '),
           'TOPO_PROJECTION', projection, 'STAINS', CASE vectors WHEN 'fixed' THEN '' ELSE vectors END, 'PH_TRANS_SUPPORTED', IF(verdict = 'ph_trans_supported', '1', '0')) AS (key, recommended)""",
    )
    own = overrides.select("marker", "key", F.nullif("value", F.lit("")).alias("own"))
    return rows.join(own, ["marker", "key"], "left").select("marker", "key", F.coalesce("own", "recommended").alias("value"))


def cheapest(rows: DataFrame, keys: list[str], within: float = 0.01) -> DataFrame:
    """For each key the best row, and the coarsest within `within` of it where that is coarser than the best; of equal ones the first by combo_no."""
    w = Window.partitionBy(*keys)
    best = F.row_number().over(w.orderBy(F.desc("auroc"), "combo_no"))
    close = rows.withColumn("best", best == 1).withColumn("_m", F.max("auroc").over(w)).where(F.col("auroc") >= F.col("_m") - within)
    close = close.withColumn("_b", F.max(F.when(F.col("best"), F.col("downsample"))).over(w)).withColumn("_c", F.row_number().over(w.orderBy(F.desc("downsample"), "combo_no")))
    return close.where(F.col("best") | ((F.col("_c") == 1) & (F.col("downsample") > F.col("_b")))).drop("_m", "_b", "_c")
