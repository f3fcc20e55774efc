"""Predictions of many folds, put together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.operators.errorrate import RATES
from kgloom.operators.quantiles import quantiles
from kgloom.schema import group_by_known

ESTIMATES = ("score", *[f"{r}_est" for r in RATES])


def over_folds(preds: DataFrame, keys: tuple[str, str] = ("drug", "protein"), values: tuple[str, ...] = ESTIMATES, min_folds: int = 1) -> DataFrame:
    """Per pair: lists of values in order of fold, their means, in_n_folds; pairs in at least min_folds folds."""
    rows = F.array_sort(F.collect_list(F.struct("fold", *values)))
    out = group_by_known(preds, *keys).agg(rows.alias("__r"), *[F.avg(v).alias(f"{v}_mean") for v in values], F.count("*").alias("in_n_folds"))
    lists = [F.col("__r").getField(v).alias(v) for v in values]
    return out.where(F.col("in_n_folds") >= min_folds).select(*keys, *lists, *[f"{v}_mean" for v in values], "in_n_folds")


def enrich(df: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """Left join with metadata; several rows of metadata give several rows."""
    return df.join(meta, key, "left")


def summary(df: DataFrame, drug: str = "drug", protein: str = "protein") -> DataFrame:
    return df.agg(F.count("*").alias("n_predictions"), F.count_distinct(drug).alias("n_unique_drugs"), F.count_distinct(protein).alias("n_unique_proteins"))


def quantile_flags(df: DataFrame, value: str, weak: float = 0.05, strong: float = 0.95) -> DataFrame:
    """df with is_weak (below the lower quantile) and is_strong (above the upper one), both strict."""
    of = lambda q: F.max(F.when(F.col("q") == q, F.col("value")))
    q = quantiles(df, value, [weak, strong]).agg(of(weak).alias("__w"), of(strong).alias("__s"))
    return df.crossJoin(F.broadcast(q)).withColumns({"is_weak": F.col(value) < F.col("__w"), "is_strong": F.col(value) > F.col("__s")}).drop("__w", "__s")


def min_max(df: DataFrame, value: str, to: str = "prob") -> DataFrame:
    """df with the value scaled to [0, 1] over the whole table."""
    ends = df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    return df.crossJoin(F.broadcast(ends)).withColumn(to, (F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).drop("__lo", "__hi")
