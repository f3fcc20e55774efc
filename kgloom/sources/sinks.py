"""Writers. Spark's commit protocol and _SUCCESS files take the place of completion flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def relation_csv(edges: DataFrame, path: str) -> None:
    edges.select("src", "dst", "src_type", "dst_type", "relation").write.mode("overwrite").csv(path, header=True)


def edge_store(edges: DataFrame, path: str) -> None:
    """Edges by edge type, so a relation is a folder and reads prune the others."""
    edges.write.mode("overwrite").partitionBy("src_type", "relation", "dst_type").parquet(path)


def by_value(df: DataFrame, path: str, column: str) -> None:
    """One folder per value of the column."""
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def folds(triples: DataFrame, path: str) -> None:
    triples.write.mode("overwrite").partitionBy("fold", "split").parquet(path)


def append_metrics(row: DataFrame, path: str) -> None:
    row.write.mode("append").csv(path, header=True)


def name_list(names: DataFrame, path: str) -> None:
    names.select(F.col(names.columns[0]).cast("string")).write.mode("overwrite").text(path)


def json_metrics(row: DataFrame, path: str) -> None:
    row.write.mode("overwrite").json(path)


def flat_csv(df: DataFrame, path: str) -> None:
    """CSV with array columns as JSON text."""
    df.select(*[F.to_json(c).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]).write.mode("overwrite").csv(path, header=True)
