"""Text embeddings without a model: hashed character n-grams, with the interface of an encoder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ngrams(text: Column, n: int = 3) -> Column:
    """The overlapping n-grams of a text, one for a shorter text; a blank text counts as X."""
    trimmed = F.trim(F.coalesce(text, F.lit("")))
    full = F.when(trimmed == "", "X").otherwise(trimmed)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(full) - (n - 1))), lambda i: F.substr(full, i, F.lit(n)))


def hashed_embedding(df: DataFrame, id_col: str, text_col: str, dim: int = 64, n: int = 3) -> DataFrame:
    """id, embedding (array of float, of length one or zero) of each row; rows that repeat an id are one text.

    An n-gram's MD5 gives its place (of dim) and its sign. Counts of (id, place) are summed before they are shuffled.
    """
    rows = df.select(F.col(id_col).alias("id"), F.explode(ngrams(F.col(text_col), n)).alias("g")).withColumn("h", F.md5("g"))
    number = lambda a, size: F.conv(F.substring("h", a, size), 16, 10).cast("long")
    sums = rows.groupBy("id", (number(1, 8) % dim).cast("int").alias("k")).agg(F.sum(1 - 2 * (number(9, 1) % 2)).cast("double").alias("x"))
    size = F.sqrt(F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["x"] * p["x"]))
    vectors = sums.groupBy("id").agg(F.collect_list(F.struct("k", "x")).alias("parts")).withColumn("size", F.when(size > 0, size).otherwise(1.0))
    found = F.map_from_entries("parts")
    vector = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: (F.coalesce(F.element_at(found, k), F.lit(0.0)) / F.col("size")).cast("float"))
    return vectors.select("id", vector.alias("embedding"))
