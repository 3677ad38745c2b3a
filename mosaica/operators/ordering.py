"""Places, running sums and percentiles in a global order, without putting all rows, or all rows of a group, in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mosaica.sources.scratch import stored


def _free(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ranked(rows: DataFrame, order: list[str], name: str, groups: list[str] | None = None, strict: bool = False) -> DataFrame:
    """rows with `name` long: their place 0, 1, ... in order of the columns `order`, in each group if `groups` are named.

    Rows are dealt by ranges of groups and order, sorted within each partition and written down with their place there; a
    row's place is that plus the sizes of the partitions before, less where its group starts. Equal rows get different
    places, in any order, and a range of them can be split. A column called `name` is replaced. `strict` says that no two rows of a group are
    equal in `order`: then one write is enough, where otherwise a salt is written down first that splits equal rows.
    """
    groups = groups or []
    rows = rows.drop(name) if name not in [*groups, *order] else rows
    salt, at, part, start, first = (_free(rows, f"_{x}") for x in ("salt", "at", "part", "start", "first"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the salt is written down before rows are dealt by it, so a task that runs again deals them alike
    rows = rows if strict else stored(rows.withColumn(salt, F.rand(7)))
    by = [*groups, *order, *([] if strict else [salt])]
    rows = stored(rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn(at, F.monotonically_increasing_id()).drop(salt))
    rows = rows.withColumn(part, F.shiftright(at, 33))
    counts = sorted(tuple(r) for r in rows.groupBy(part).count().collect())  # a row for each partition
    total, starts = 0, []
    for p, k in counts:
        starts.append((p, total))
        total += k
    table = F.broadcast(rows.sparkSession.createDataFrame(starts, f"{part} long, {start} long"))
    place = F.col(start) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    out = rows.join(table, part)
    if not groups:
        return out.withColumn(name, place).drop(part, start, at)
    out = out.withColumn(at, place).drop(part, start)
    firsts = out.groupBy(*groups).agg(F.min(at).alias(first))
    keys = {g: _free(out, f"_g{i}") for i, g in enumerate(groups)}
    firsts = firsts.select(*[F.col(g).alias(k) for g, k in keys.items()], first)
    same = F.lit(True)
    for g, k in keys.items():
        same = same & F.col(g).eqNullSafe(F.col(k))
    return out.join(firsts, same).withColumn(name, F.col(at) - F.col(first)).drop(at, first, *keys.values())


def running(rows: DataFrame, groups: list[str], order: list[str | Column], amount: Column, name: str) -> DataFrame:
    """rows with `name`: the sum of `amount` over the rows before in their group, in the given order, which must be strict.

    Rows are dealt by ranges of groups and order; sums within a range add to those of the ranges before it.
    """
    part, more, local, start = (_free(rows, f"_{x}") for x in ("part", "more", "local", "start"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    before = (Window.unboundedPreceding, -1)
    rows = stored(rows.withColumn(more, amount).repartitionByRange(n, *groups, *order).withColumn(part, F.spark_partition_id()))
    sums = rows.groupBy(*groups, part).agg(F.sum(more).alias(more))  # groups and ranges, not their product
    starts = sums.select(*groups, part, F.coalesce(F.sum(more).over(Window.partitionBy(*groups).orderBy(part).rowsBetween(*before)), F.lit(0)).alias(start))
    inner = Window.partitionBy(part, *groups).orderBy(*order).rowsBetween(*before)
    rows = rows.withColumn(local, F.coalesce(F.sum(more).over(inner), F.lit(0)))
    return rows.join(starts, [*groups, part]).withColumn(name, F.col(start) + F.col(local)).drop(part, more, local, start)


def percentiles(rows: DataFrame, keys: list[str], value: str, at: list[float], low: float, high: float, bins: int = 4096) -> DataFrame:
    """keys and `p`, an array: the exact percentiles `at` (0..1, between two values in proportion) of `value`, which lies in low..high.

    Two passes that gather no group. The first counts values by bins, which names the bins that hold the places wanted; the
    second looks for these places among the values of those bins, counted by value.
    """
    step = F.lit(bins / (high - low))
    slot = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(value) - low) * step))).cast("int")
    rows = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), slot.alias("_bin"))
    counts = rows.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*keys)  # `bins` rows a group at most
    upto = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sized = counts.withColumn("_before", upto(whole.orderBy("_bin"))).withColumn("_all", F.sum("_n").over(whole))
    exact = [F.lit(float(q)) * (F.col("_all") - 1) for q in at]
    places = F.array_distinct(F.array(*[f(x).cast("long") for x in exact for f in (F.floor, F.ceil)]))
    inside = F.filter(places, lambda x: (x >= F.col("_before")) & (x < F.col("_before") + F.col("_n")))
    wanted = sized.select(*keys, "_bin", "_before", "_all", inside.alias("_places")).where(F.size("_places") > 0)
    held = rows.join(wanted, [*keys, "_bin"]).groupBy(*keys, "_bin", "_before", "_all", "_places", "_v").agg(F.count(F.lit(1)).alias("_n"))
    start = F.col("_before") + upto(Window.partitionBy(*keys, "_bin").orderBy("_v"))
    found = held.withColumn("_start", start).select(*keys, "_all", "_v", F.explode("_places").alias("_place"), "_start", "_n").where("_place >= _start AND _place < _start + _n")
    by = found.groupBy(*keys, "_all").agg(F.map_from_entries(F.collect_list(F.struct("_place", "_v"))).alias("_m"))  # two entries for each of `at`
    lower, upper = ([F.element_at("_m", f(x).cast("long")) for x in exact] for f in (F.floor, F.ceil))
    return by.select(*keys, F.array(*[a + (x - F.floor(x)) * (b - a) for a, b, x in zip(lower, upper, exact, strict=True)]).alias("p"))
