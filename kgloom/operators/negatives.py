"""Negative triples by corruption, and novel candidate triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgloom.schema import product


def corrupted(positives: DataFrame, known: DataFrame, n: int, n_heads: int, n_tails: int, which: str = "both", draws: int = 4, seed: int = 42) -> DataFrame:
    """head, tail, neg_head, neg_tail: up to n negatives for each positive (head, tail), none of them known.

    Replacements are drawn with integer arithmetic, so any engine draws the same; heads and tails are
    replaced by ids of their own kind. `draws` times n candidates are made for each positive, which covers known and repeated ones.
    """
    sides = {"head": ["h"], "tail": ["t"], "both": ["h", "t"]}[which]
    rows = positives.select("head", "tail").distinct().withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n * draws - 1))))
    rows = rows.withColumn("side", F.array(*[F.lit(s) for s in sides])[F.col("c") % len(sides)])
    draw = (F.col("head") * 7919 + F.col("tail") * 104729 + F.col("c") * 15485863 + seed * 32452843) % 2147483647
    draw = (draw * 48271) % 2147483647
    rows = rows.withColumns({"neg_head": F.when(F.col("side") == "h", draw % n_heads).otherwise(F.col("head")), "neg_tail": F.when(F.col("side") == "t", draw % n_tails).otherwise(F.col("tail"))})
    fresh = rows.groupBy("head", "tail", "neg_head", "neg_tail").agg(F.min("c").alias("c"))
    taken = known.select(F.col("head").alias("neg_head"), F.col("tail").alias("neg_tail")).distinct()
    fresh = fresh.join(taken, ["neg_head", "neg_tail"], "left_anti")
    first = Window.partitionBy("head", "tail").orderBy("c")
    return fresh.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= n).select("head", "tail", "neg_head", "neg_tail")


def candidates(heads: DataFrame, tails: DataFrame, known: DataFrame) -> DataFrame:
    """All (head, tail) that aren't known."""
    return product(heads, tails).join(known.select("head", "tail").distinct(), ["head", "tail"], "left_anti")


def top_by_degrees(heads: DataFrame, tails: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """head, tail, score: the k best novel pairs under score = hd * td, ties by ids; heads(head, hd), tails(tail, td).

    Classes of pairs with equal degrees are counted first, known pairs taken off, and only the best classes that hold k novel pairs are
    spelt out, with all that tie with the last one; the grid of all pairs is never made.
    """
    a, b = heads.groupBy("hd").agg(F.count("*").alias("_nh")), tails.groupBy("td").agg(F.count("*").alias("_nt"))
    taken = known.select("head", "tail").distinct().join(heads, "head").join(tails, "tail").groupBy("hd", "td").agg(F.count("*").alias("_taken"))
    classes = product(a, b).join(taken, ["hd", "td"], "left").withColumn("score", F.col("hd") * F.col("td"))
    novel = classes.groupBy("score").agg(F.sum(F.col("_nh") * F.col("_nt") - F.coalesce("_taken", F.lit(0))).alias("_n")).where("_n > 0")
    best = novel.orderBy(F.desc("score")).limit(k).withColumn("_before", F.sum("_n").over(Window.orderBy(F.desc("score"))) - F.col("_n"))
    least = best.where(F.col("_before") < k).agg(F.min("score").alias("_least"))
    high = classes.crossJoin(F.broadcast(least)).where(F.col("score") >= F.col("_least")).select("hd", "td", "score")
    pairs = heads.join(high.select("hd").distinct(), "hd", "left_semi").join(high, "hd").join(tails, "td")
    return top_novel(pairs.join(known.select("head", "tail").distinct(), ["head", "tail"], "left_anti"), k).select("head", "tail", "score")


def top_novel(scored: DataFrame, k: int) -> DataFrame:
    """The k best candidates, ties by ids; a top-k sort, not a full one."""
    return scored.orderBy(F.desc("score"), "head", "tail").limit(k)
