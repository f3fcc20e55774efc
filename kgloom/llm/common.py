"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.schema import small

#: Up to so many rows of three numbers a list is sent to all tasks.
SEND_ROWS = 200_000
#: The ASCII white space [\x20\x09-\x0D] that the text contracts name.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def released(each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """each, for mapInArrow, giving what Arrow has freed back to the system after each batch: workers live on through all stages of a job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in each(batches):
            yield out
            del out
            pa.default_memory_pool().release_unused()

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local master, as in tests, may do without the setting."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that the driver and all executors share")
        path = os.path.join(tempfile.gettempdir(), "kgloom-checkpoints")
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, by: list[str] = ()) -> DataFrame:
    """Cut the lineage: write df to the shared folder as Parquet, a folder for each value of the columns `by`, and read it again.

    A written table survives the loss of any executor, and is read by column.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete what was written to a new_path(), once nothing reads it any more."""
    if path.startswith(shared_dir(spark) + "/"):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table that materialize() wrote, once nothing reads them any more."""
    spark = df.sparkSession
    root = shared_dir(spark)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if root.split(":", 1)[-1].lstrip("/") in folder:
            path.getFileSystem(conf).delete(path, True)


def split_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join whose hot keys adaptive execution can split; the first key is a long; key columns come from the left.

    A right side that comes out of groupBy(keys) already lies by its keys, and would be joined as it lies: then the left side's
    partitions can't be split. The join by the inverted bits of the first key gives both sides an exchange of their own.
    """
    first, *rest = keys
    other = right.select(*[F.col(c).alias(f"_{c}" if c in keys else c) for c in right.columns])
    same = F.bitwise_not(F.col(first)) == F.bitwise_not(F.col(f"_{first}"))
    for k in rest:
        same &= F.col(k) == F.col(f"_{k}")
    return left.join(other, same, how).drop(*[f"_{k}" for k in keys])


def with_marks(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """docs with two columns, and their names, that tell rows of one id apart: hashes of the text, and of a row number where the id is null.

    Rows without an id are written first, so that their numbers are the same whenever they are read.
    """
    row = fresh("_row", docs)
    alone = materialize(docs.where(docs[id_col].isNull()).withColumn(row, F.monotonically_increasing_id()), "without-id")
    rows = docs.where(docs[id_col].isNotNull()).withColumn(row, F.lit(-1).cast("long")).unionByName(alone)
    text = F.coalesce(F.col(text_col), F.lit(""))
    x, y = fresh("_x", docs), fresh("_y", docs)
    return rows.withColumns({x: F.xxhash64(row, text), y: F.hash(text, row)}).drop(row), [x, y]


def without_rows(rows: DataFrame, marks: list[str], gone: DataFrame, id_col: str) -> DataFrame:
    """The rows of with_marks() that are not in gone(id, x, y); the columns as they were before it.

    The list is written and, up to SEND_ROWS, sent to all tasks, so that whole texts aren't shuffled to meet it; a longer one is joined by key.
    """
    gone = materialize(gone.select(F.col("id").alias("_gone"), F.col("x").alias("_gone_x"), F.col("y").alias("_gone_y")).distinct(), "gone")
    gone = F.broadcast(gone) if small(gone, SEND_ROWS) else gone.hint("merge")
    same = rows[id_col].eqNullSafe(gone["_gone"]) & (rows[marks[0]] == gone["_gone_x"]) & (rows[marks[1]] == gone["_gone_y"])
    return rows.join(gone, same, "left_anti").drop(*marks)


def one_of_repeated(rows: DataFrame, marks: list[str], repeated: DataFrame, id_col: str) -> DataFrame:
    """rows of with_marks() with one row of each repeated(id, x, y), that of the least JSON text; the rest as they are. repeated may be empty."""
    if repeated.isEmpty():
        return rows
    keys = repeated.select(F.col("id").alias("_again"), F.col("x").alias("_again_x"), F.col("y").alias("_again_y")).distinct()
    same = rows[id_col].eqNullSafe(keys["_again"]) & (rows[marks[0]] == keys["_again_x"]) & (rows[marks[1]] == keys["_again_y"])
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    mine = rows.join(keys, same, "left_semi")
    one = mine.groupBy(id_col, *marks).agg(F.min_by(whole, F.to_json(whole)).alias("_row")).select("_row.*")
    return rows.join(keys, same, "left_anti").unionByName(one)


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
