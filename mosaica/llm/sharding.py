"""Sharding by longest-processing-time scheduling.

Groups that must stay together are the jobs, shards the machines: jobs go in order of falling size to
the least-loaded shard, which a heap yields. At scale only big jobs need to be placed one by one. Groups
below a share of the total (1 / (shards * FINE)) are first packed by a hash of their key into shards *
FINE bundles, and the bundles are jobs too. So the heap sees at most 2 * shards * FINE jobs whatever the
input holds, a bound that follows from the threshold, and the loads differ by about one bundle at most.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaica.llm.common import col, free, ready, stored
from mosaica.operators.ordering import ranked

#: Jobs of the average size for each shard; 2 * shards * FINE bounds what reaches the driver.
FINE = 512


def schedule(jobs: list[tuple[int, str]], shards: int) -> dict[str, int]:
    """The shard of each job (size, name): largest first, ties by name, to the least-loaded shard, ties to the lowest."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for size, name in sorted(jobs, key=lambda j: (-j[0], j[1])):
        load, s = heapq.heappop(heap)
        out[name] = s
        heapq.heappush(heap, (load + size, s))
    return out


def shard(rows: DataFrame, group: str, size: str, order: list[str], shards: int = 24, fine: int = FINE) -> DataFrame:
    """rows, without `group`, with `shard` int (0..shards-1) and `slot` long (0, 1, ... without gaps in each shard).

    Rows with an equal `group` (nulls count as one group) get one shard; loads in `size` (long, nulls
    count 0) are as equal as whole groups allow. `order` sorts slots; repeated rows get a slot each.
    Columns of rows named shard or slot are replaced. An empty table gives no rows. Null and very large groups are groups
    like any other; a group larger than a shard's share still stays together, so loads can then not be equal.
    """
    spark = ready(rows.sparkSession)
    names = [c for c in rows.columns if c not in ("shard", "slot", group)]
    key, bundle, large, small, job = (free(rows, x) for x in ("_key", "_bundle", "_large", "_small", "_job"))
    rows = rows.select(*map(col, names), F.sha2(F.coalesce(F.concat(F.lit("="), col(group).cast("string")), F.lit("null")), 256).substr(1, 32).alias(key))
    groups = stored(rows.groupBy(key).agg(F.sum(F.coalesce(col(size), F.lit(0))).alias("size")))
    total = groups.agg(F.sum("size")).first()[0] or 0
    limit = total // (shards * fine) + 1
    of_key = F.concat(F.lit("z"), F.pmod(F.xxhash64(key), F.lit(shards * fine)).cast("string"))
    big = F.col("size") >= limit  # keys are hexadecimal, bundles start with z; at most shards * fine of these: each has that share of the total
    jobs = groups.groupBy(F.when(big, F.col(key)).otherwise(of_key).alias("job")).agg(F.sum("size").alias("size"))
    placed = schedule([(r["size"], r["job"]) for r in jobs.collect()], shards)
    plan = spark.createDataFrame(list(placed.items()) or [("", 0)], f"{job} string, shard int")
    # the plan has at most 2 * shards * fine rows of two short fields, so both joins may broadcast it
    of_bundle = F.broadcast(plan.where(F.col(job).startswith("z")).select(F.col(job).alias(bundle), F.col("shard").alias(small)))
    of_group = F.broadcast(plan.where(~F.col(job).startswith("z")).select(F.col(job).alias(key), F.col("shard").alias(large)))
    dealt = rows.withColumn(bundle, of_key).join(of_group, key, "left").join(of_bundle, bundle, "left").select(*map(col, names), F.coalesce(large, small).alias("shard"))
    return ranked(dealt, order, "slot", ["shard"])
