"""Matrices in blocks: written as Parquet, read by rows and columns without touching other blocks.

A matrix is three tables in a folder: `rows` and `columns` (id, at: the place in the order of the ids), and `blocks`
(row_block, column_block, data, cells, values): data has the float32 numbers of BLOCK_ROWS x BLOCK_COLUMNS cells in row order, where absent cells are
zero; a block with few cells has no data, but the places and values of those it has, so that a matrix takes no more room than its cells. Blocks lie in a folder for
each row_block and are sorted by column_block, so a choice of rows prunes folders and a choice of columns prunes row groups by their least and greatest
column_block; only what is chosen of a block is ever unpacked. Ids are looked up by joins, so a choice may be in any order and still reads the file in its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.schema import position, small

BLOCK_ROWS, BLOCK_COLUMNS = 256, 512
#: So many chosen blocks of either side are named to the scan; more are left to the join.
NAMED = 2000
#: A block with at most this share of its cells is written as places and values, which take twice the room of a number.
FEW = 0.5
BLOCK = "column_block int, height int, width int, data binary, cells array<int>, values array<float>"


def write_matrix(cells: DataFrame, path: str, row: str = "row", column: str = "column", value: str = "value", block_rows: int = BLOCK_ROWS, block_columns: int = BLOCK_COLUMNS) -> None:
    """Write the cells; ids are kept as text. Cells of null ids or values are left out; of a repeated cell the greatest value stays."""
    spark = cells.sparkSession
    known = cells.select(F.col(row).cast("string").alias("row"), F.col(column).cast("string").alias("column"), F.col(value).cast("float").alias("value")).dropna()
    for side in ("row", "column"):
        position(known.select(F.col(side).alias("id")).distinct(), "id", name="at").select("id", "at").write.parquet(f"{path}/{side}s")
    at = lambda side: spark.read.parquet(f"{path}/{side}s").select(F.col("id").alias(side), F.col("at").alias(f"{side}_at"))
    placed = known.join(at("row"), "row").join(at("column"), "column")
    placed = placed.select(
        F.floor(F.col("row_at") / block_rows).cast("int").alias("row_block"), F.floor(F.col("column_at") / block_columns).cast("int").alias("column_block"),
        (F.col("row_at") % block_rows * block_columns + F.col("column_at") % block_columns).cast("int").alias("cell"), "value",
    )
    size = block_rows * block_columns

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of sorted cells; the last one of a batch waits for its rest."""
        names, rest = ("row_block", "column_block", "cell", "value"), None
        for batch in batches:
            now = [batch.column(n).to_numpy() for n in names]
            rest = now if rest is None else [np.concatenate(x) for x in zip(rest, now)]
            changes = np.flatnonzero((np.diff(rest[0]) != 0) | (np.diff(rest[1]) != 0))
            if len(changes):
                yield from made([x[: changes[-1] + 1] for x in rest])
                rest = [x[changes[-1] + 1 :] for x in rest]
        if rest is not None and len(rest[0]):
            yield from made(rest)

    def made(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        same = (np.diff(rows[0]) == 0) & (np.diff(rows[1]) == 0)
        r, c, cell, value = (x[np.append(~(same & (np.diff(rows[2]) == 0)), True)] for x in rows)  # of a repeated cell, the last and so greatest value
        starts = np.concatenate([[0], np.flatnonzero((np.diff(r) != 0) | (np.diff(c) != 0)) + 1, [len(r)]])
        full = np.diff(starts) > FEW * size
        for k in np.flatnonzero(full):
            own, data = slice(starts[k], starts[k + 1]), np.zeros(size, np.float32)
            data[cell[own]] = value[own]
            yield batch_of(r[own][:1], c[own][:1], pa.array([data.tobytes()], pa.binary()), *(pa.nulls(1, pa.list_(t)) for t in (pa.int32(), pa.float32())))
        some, n = np.repeat(~full, np.diff(starts)), np.diff(starts)[~full]
        if len(n):
            lists = (pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(x[some])) for x in (cell, value))
            yield batch_of(r[starts[:-1][~full]], c[starts[:-1][~full]], pa.nulls(len(n), pa.binary()), *lists)

    def batch_of(r: np.ndarray, c: np.ndarray, data: pa.Array, cells: pa.Array, values: pa.Array) -> pa.RecordBatch:
        shape = (pa.array(np.full(len(r), x, np.int32)) for x in (block_rows, block_columns))
        return pa.RecordBatch.from_arrays([pa.array(r), pa.array(c), *shape, data, cells, values], names=["row_block", "column_block", "height", "width", "data", "cells", "values"])

    in_order = placed.repartitionByRange("row_block", "column_block").sortWithinPartitions("row_block", "column_block", "cell", "value")
    in_order.mapInArrow(packed, f"row_block int, {BLOCK}").write.option("parquet.block.size", str(8 << 20)).partitionBy("row_block").parquet(f"{path}/blocks")


def _known(spark: SparkSession, path: str, side: str, ids: DataFrame | None) -> DataFrame:
    """id, at of the chosen ids."""
    known = spark.read.schema("id string, at long").parquet(f"{path}/{side}s")
    return known if ids is None else known.join(ids.select(F.col(ids.columns[0]).cast("string").alias("id")).distinct(), "id", "left_semi")


def _chosen(known: DataFrame, side: str, size: int) -> DataFrame:
    """block, ids, ats: the chosen ids of each block with their places in it; at most `size` a block."""
    each = F.sort_array(F.collect_list(F.struct((F.col("at") % size).cast("int").alias("at"), "id")))
    return known.groupBy(F.floor(F.col("at") / size).cast("int").alias(f"{side}_block")).agg(each.alias("e")).select(f"{side}_block", F.col("e.id").alias(f"{side}_ids"), F.col("e.at").alias(f"{side}_ats"))


def read_matrix(spark: SparkSession, path: str, rows: DataFrame | None = None, columns: DataFrame | None = None, keep_zeros: bool = False) -> DataFrame:
    """row, column, value of the chosen rows and columns (tables of ids; all without them); ids that the matrix hasn't are no error.

    The cells of blocks with few of them are joined with the chosen places; those of other blocks are cut out of their data.
    """
    blocks = spark.read.schema(f"{BLOCK}, row_block int").parquet(f"{path}/blocks")
    shape = blocks.select("height", "width").first()
    if shape is None:
        return spark.createDataFrame([], "row string, column string, value float")
    dense, size = [], {"row": shape.height, "column": shape.width}
    known = {side: _known(spark, path, side, ids) for side, ids in (("row", rows), ("column", columns))}
    for side, ids in (("row", rows), ("column", columns)):
        chosen = _chosen(known[side], side, size[side])
        if ids is not None and small(numbers := known[side].select(F.floor(F.col("at") / size[side]).cast("int").alias("block")).distinct(), NAMED):
            names = sorted(r[0] for r in numbers.collect())
            blocks = blocks.where(F.col(f"{side}_block").isin(names)) if names else blocks.where(F.lit(False))
            chosen = F.broadcast(chosen)
        dense.append(chosen)
    shape_ = (shape.height, shape.width)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                if batch.column("data")[k].is_valid:
                    data = np.frombuffer(batch.column("data")[k].as_buffer(), np.float32).reshape(shape_)
                else:
                    data = np.zeros(shape_, np.float32)
                    data.ravel()[np.asarray(batch.column("cells")[k].values)] = np.asarray(batch.column("values")[k].values)
                r, c = (np.asarray(batch.column(f"{s}_ats")[k].values) for s in ("row", "column"))
                part = data[np.ix_(r, c)]
                i, j = np.nonzero(part) if not keep_zeros else (x.ravel() for x in np.indices(part.shape))
                ids = (batch.column(f"{s}_ids")[k].values.take(pa.array(x)) for s, x in (("row", i), ("column", j)))
                yield pa.RecordBatch.from_arrays([*ids, pa.array(part[i, j])], names=["row", "column", "value"])

    whole = blocks if keep_zeros else blocks.where("coalesce(octet_length(data), 0) > 0")
    for side, chosen in zip(size, dense):
        whole = whole.join(chosen, f"{side}_block")
    out = whole.select("data", "cells", "values", "row_ids", "row_ats", "column_ids", "column_ats").mapInArrow(unpacked, "row string, column string, value float")
    if keep_zeros:
        return out
    cells = blocks.select("row_block", "column_block", F.explode(F.arrays_zip("cells", "values")).alias("e")).where("e.values <> 0")
    cells = cells.select((F.col("row_block").cast("long") * shape.height + F.floor(F.col("e.cells") / shape.width)).alias("row_at"), (F.col("column_block").cast("long") * shape.width + F.col("e.cells") % shape.width).alias("column_at"), F.col("e.values").alias("value"))
    for side in size:
        cells = cells.join(known[side].select(F.col("id").alias(side), F.col("at").alias(f"{side}_at")), f"{side}_at")
    return out.unionByName(cells.select("row", "column", "value"))
