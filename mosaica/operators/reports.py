"""Reports over diagrams and decisions: topology terms, inspected pairs, cost matrices, matched losses, marker lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mosaica.operators.persistence import assignment, distance, set_distance
from mosaica.operators.scoring import SETTING, top_candidates

#: Each term compares an image with what was generated from it.
TERMS = {"cyc_h": ("real_A", "rec_A"), "cyc_i": ("real_B", "rec_B"), "trans_h": ("real_A", "fake_B"), "trans_i": ("real_B", "fake_A")}
ROLES = sorted({r for pair in TERMS.values() for r in pair})


def topology_report(packed: DataFrame, keys: list[str], tile: str = "tile", cyc: float = 1.0, trans: float = 1.0, scale: float = 1.0, channels: tuple[str, ...] = ()) -> DataFrame:
    """One row for each key: the four terms as means over tiles, how many tiles lack a role, and the weighted total.

    packed: keys, tile, role, p0, p1. Each diagram is packed once and serves both terms of its source. With `channels`, cyc_i is the sum over these
    struct columns (p0, p1) of the diagrams of one channel each; the columns p0 and p1 serve the other terms. Tiles that lack
    a role count as `incomplete` and in no mean; a key without complete tiles has null terms.
    """
    rows = packed.select(*keys, tile, "role", F.struct(F.struct("p0", "p1").alias("whole"), *channels).alias("g"))
    wide = rows.groupBy(*keys, tile).pivot("role", ROLES).agg(F.first("g"))
    whole = F.lit(True)
    for r in ROLES:
        whole = whole & F.col(r).isNotNull()
    fields = {name: channels if name == "cyc_i" and channels else ("whole",) for name in TERMS}
    terms = [F.when(whole, sum((distance(f"{a}.{f}", f"{b}.{f}") for f in fields[name]), F.lit(0.0))).alias(name) for name, (a, b) in TERMS.items()]
    means = wide.select(*keys, whole.alias("_whole"), *terms).groupBy(*keys)
    got = means.agg(*[F.avg(t).alias(t) for t in TERMS], F.count_if("_whole").alias("n_tiles"), F.count_if(~F.col("_whole")).alias("incomplete"))
    total = F.lit(scale) * (F.lit(cyc) * (F.col("cyc_h") + F.col("cyc_i")) + F.lit(trans) * (F.col("trans_h") + F.col("trans_i")))
    return got.withColumn("total", total)


def inspected(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """pairs with d0, d1 (distance of each dimension), total, and the points of both diagrams."""
    by_dim = {f"d{k}": set_distance(F.col(f"{a}.p{k}"), F.col(f"{b}.p{k}")) for k in (0, 1)}
    points = {f"points{k}_{x}": F.size(F.col(f"{c}.p{k}")) for k in (0, 1) for x, c in (("a", a), ("b", b))}
    return pairs.withColumns(by_dim | points).withColumn("total", F.col("d0") + F.col("d1"))


def inspection_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """For each key how many pairs were inspected, and mean, least and largest total distance."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("total").alias("mean_total"), F.min("total").alias("min_total"), F.max("total").alias("max_total"))


def cost_matrix(left: DataFrame, right: DataFrame, batch: str, a: str = "a", b: str = "b") -> DataFrame:
    """The distance of every left diagram to every right one of its batch; batches are small by definition (sets to be matched)."""
    return left.join(right, batch).withColumn("cost", distance(a, b)).drop(a, b)


def paired_loss(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """n, mean_loss and sum_loss of diagrams paired by `key` (left: key, a; right: key, b). A key without a partner is an error."""
    for one, other in ((left, right), (right, left)):
        alone = one.join(other.select(key), key, "left_anti").first()
        if alone is not None:
            raise ValueError(f"{key} {alone[key]!r} has no partner")
    d = left.join(right, key).select(distance("a", "b").alias("d"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_loss"), F.sum("d").alias("sum_loss"))


#: Entries of a cost matrix that one task takes on; the assignment of a batch can't be split.
MOST_COSTS = 4_000_000


def matched_loss(costs: DataFrame, batch: str, row: str, col: str) -> DataFrame:
    """For each batch the assignment of least cost: how many were matched, mean and sum. One task matches a batch at a time; one over MOST_COSTS is an error."""
    kind = costs.schema[batch].dataType.simpleString()
    most = costs.groupBy(batch).count().agg(F.max("count")).first()[0] or 0
    if most > MOST_COSTS:
        raise ValueError(f"a batch has {most} costs; at most {MOST_COSTS} can be matched")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        c = pdf.pivot(index=row, columns=col, values="cost").to_numpy()
        best = [c[i, j] for i, j in assignment(c)]
        return pd.DataFrame({batch: [pdf[batch].iloc[0]], "matched": [len(best)], "mean_loss": [float(np.mean(best))], "sum_loss": [float(np.sum(best))]})

    return costs.select(batch, row, col, "cost").groupBy(batch).applyInPandas(solve, f"{batch} {kind}, matched long, mean_loss double, sum_loss double")


def matched_sets(left: DataFrame, right: DataFrame, batch: str, row: str, col: str, a: str = "a", b: str = "b") -> DataFrame:
    """matched_loss() of the diagrams of each batch (left: batch, row, a; right: batch, col, b); a batch that one side lacks has matched, mean_loss and sum_loss 0."""
    every = left.select(batch).union(right.select(batch)).distinct()
    got = matched_loss(cost_matrix(left, right, batch, a, b), batch, row, col)
    return every.join(got, batch, "left").na.fill(0, ["matched", "mean_loss", "sum_loss"])


def confirm_set(screen: DataFrame, second: DataFrame) -> DataFrame:
    """The best settings of the screen with their place and, from the strict rows of the second slice, confirm_auroc and n_tiles.

    second: marker, vectors, control, setting, auroc, n_tiles. A setting that the second slice lacks is left out.
    """
    keys = ["marker", "vectors", *SETTING]
    again = second.where("control = 'strict'").select(*keys, F.col("auroc").alias("confirm_auroc"), "n_tiles")
    return top_candidates(screen).drop("n_tiles", "confirm_auroc").join(again, keys)


def setting_label() -> Column:
    """A setting in words. The format is a fixed value."""
    return F.format_string("%s / %s  ds=%d dims=%s proj=%s", *SETTING)


def marker_lists(verdicts: DataFrame) -> DataFrame:
    """For each verdict its markers, in order."""
    by = verdicts.groupBy("verdict").agg(F.array_sort(F.collect_set("marker")).alias("_m"))
    return by.select("verdict", F.size("_m").cast("long").alias("n_markers"), F.array_join("_m", ", ").alias("markers"))


def report_rows(decided: DataFrame) -> DataFrame:
    """The confirmed candidates of each marker as lines, best first."""
    line = F.row_number().over(Window.partitionBy("marker").orderBy(F.desc("confirm_auroc"), "vectors", "place"))
    return decided.select("marker", line.alias("line"), "vectors", setting_label().alias("setting"), "n_tiles", "confirm_auroc", "z_observed", "supported")
