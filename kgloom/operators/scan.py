"""Running sums within groups, split across tasks.

A window over a hot group is one task. Here rows are range-partitioned by group and order, so a hot group spans many
partitions; each task sums its own rows, and what stands before a partition in its first group is added afterwards: one
row at most for each partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgloom import schema
from kgloom.schema import parts_of
from kgloom.storage import materialize


def running_sums(df: DataFrame, group: list[str], order: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """df with a column for each of `sums` (new name -> column): the sum of the column over the group's rows up to this one.

    A window holds all rows of its partition, so there are as many partitions as the rows need. Rows that tie in the order share their sum. Null groups are a group; null values count as nothing. The rows are written once,
    so that both uses see the same partitions.
    """
    by = F.desc_nulls_last(order) if descending else F.asc_nulls_first(order)
    keys = [F.col(g) for g in group]
    dealt = lambda d, *n: materialize(d.repartitionByRange(*n, *keys, by).withColumn("__part", F.spark_partition_id()), "runs")
    placed = dealt(df)
    most = placed.groupBy("__part").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    parts = parts_of(placed)
    if most > 4 * schema.TASK_ROWS:  # adaptive execution has put too many rows together
        placed = dealt(placed.select(*df.columns), parts)
    totals = placed.groupBy(*keys, "__part").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"__t{k}") for k, c in enumerate(sums.values())])
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumns({f"__b{k}": F.sum(f"__t{k}").over(earlier) for k in range(len(sums))}).where("__b0 IS NOT NULL")
    before = before.select(*[F.col(g).alias(f"__{g}") for g in group], F.col("__part").alias("__in"), *[f"__b{k}" for k in range(len(sums))])
    own = Window.partitionBy(*keys, "__part").orderBy(by)
    within = placed.repartition(parts, *keys, "__part").withColumns({n: F.coalesce(F.sum(c).over(own), F.lit(0)) for n, c in sums.items()})
    same = F.col("__part") == F.col("__in")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"__{g}"))
    out = within.join(F.broadcast(before), same, "left")  # only a partition's first group has rows before it
    return out.select(*df.columns, *[(F.col(n) + F.coalesce(f"__b{k}", F.lit(0))).alias(n) for k, n in enumerate(sums)])
