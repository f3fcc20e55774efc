"""Table shapes and null-safe building blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A relation table: one row per edge of a typed multigraph.
EDGE = T.StructType([T.StructField(c, T.StringType()) for c in ("src", "dst", "src_type", "dst_type", "relation")])
EDGE_COLUMNS = EDGE.fieldNames()

TRIPLE = T.StructType(
    [T.StructField("split", T.StringType())]
    + [T.StructField("head_type", T.StringType()), T.StructField("head", T.LongType()), T.StructField("relation", T.LongType())]
    + [T.StructField("tail_type", T.StringType()), T.StructField("tail", T.LongType())]
)

#: One side of a product or a lookup is broadcast up to this many rows; beyond, it is dealt out in blocks.
BROADCAST_ROWS = 200_000

#: Rows of a task that holds all of its rows, in a sort, a hash table or a window.
TASK_ROWS = 250_000


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi join in which null keys match null keys; key columns come from the left."""
    renamed = reduce(lambda d, k: d.withColumnRenamed(k, f"__{k}"), keys, right)
    out = left.join(renamed, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), how)
    return out.drop(*[f"__{k}" for k in keys])


def group_by_known(df: DataFrame, *keys: str):
    """groupBy without the groups of null keys."""
    return df.dropna(subset=list(keys)).groupBy(*keys)


def first_known(value: str | Column, order: str | Column) -> Column:
    """Aggregate: the first value that isn't null, by the order."""
    value = F.col(value) if isinstance(value, str) else value
    order = F.col(order) if isinstance(order, str) else order
    return F.min_by(value, F.when(value.isNotNull(), order))


def last_value(value: str, order: str) -> Column:
    """Aggregate: the value with the greatest order; of a repeated key, the last one wins."""
    return F.max_by(value, order)


def holds(condition: Column) -> Column:
    """The condition with null as false, so that its negation is true for nulls."""
    return F.coalesce(condition, F.lit(False))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows; reads no more than one more than that."""
    return df.limit(rows + 1).count() <= rows


def parts_of(df: DataFrame, each: float = 1.0) -> int:
    """The number of partitions in which df, of which a row becomes `each` rows, has about TASK_ROWS rows in one.

    Adaptive execution puts partitions together by their compressed bytes, whatever the rows in them; it leaves those whose number is given.
    """
    return max(1, -(-int(df.count() * each) // TASK_ROWS))


def product(left: DataFrame, right: DataFrame, blocks: int = 64) -> DataFrame:
    """All pairs of two row sets with different column names.

    A checked small side is broadcast. If neither is small, the right side is dealt into blocks and each left row
    goes to every block once: tasks then hold one block, not a whole side.
    """
    if small(right):
        return left.crossJoin(F.broadcast(right))
    if small(left):
        return F.broadcast(left).crossJoin(right)
    a = left.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    b = right.withColumn("__block", F.pmod(F.xxhash64(*right.columns), F.lit(blocks)).cast("int"))
    return a.join(b, "__block").drop("__block")


def with_constants(df: DataFrame, row: DataFrame) -> DataFrame:
    """df with the columns of a one-row aggregate."""
    return df.crossJoin(F.broadcast(row))


def position(df: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """df with each row's 0-based place in the order, without a window over all rows.

    Rows are range-partitioned and numbered inside each partition; partition totals, one row per
    partition, are added up. The numbered rows are written once, so both uses see the same partitions.
    """
    from kgloom.storage import materialize

    ranked = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    ranked = materialize(ranked.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "positions")
    totals = ranked.groupBy("__part").agg(F.count("*").alias("__n"))
    before = totals.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return ranked.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")
