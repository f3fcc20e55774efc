"""Error-rate curves over score thresholds, and their value at each prediction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.storage import materialize

RATES = ("fnr", "fpr", "tnr", "tpr")


def _attach(df: DataFrame, few: DataFrame, by: Sequence[str]) -> DataFrame:
    """df with the columns of a table that has one row for each value of `by` (such as folds; it comes from a written table, so Spark knows its size and broadcasts it instead of dealing df out by folds), or one row in all."""
    return df.join(few, list(by)) if by else df.crossJoin(F.broadcast(few))


def thresholds(preds: DataFrame, n: int = 250, score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """i, t: n evenly spaced thresholds from the least to the greatest score; the last is the greatest itself. For each value of `by`, as in all functions here."""
    ends = preds.groupBy(*by).agg(F.min(score).cast("double").alias("lo"), F.max(score).cast("double").alias("hi"))
    t = F.when(F.col("i") == n - 1, F.col("hi")).otherwise(F.col("lo") + F.col("i") * ((F.col("hi") - F.col("lo")) / (n - 1)))
    return ends.select(*by, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).select(*by, "i", t.alias("t"), "lo", "hi")


def curve(preds: DataFrame, n: int = 250, score: str = "score", positive: str = "test", negative: str = "negatives", by: Sequence[str] = ()) -> DataFrame:
    """i, t, lo, hi, tp, fn, fp, tn and the four rates. A rate without cases is 0.

    Each score is compared with the thresholds once: it falls between two of them, scores are counted by that
    place, and the n counts are summed up cumulatively as arrays; nothing is compared n times.
    """
    th = materialize(thresholds(preds, n, score, by), "thresholds")
    grid = th.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]).alias("ts"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    rows = _attach(preds.select(*by, F.col(score).cast("double").alias("s"), F.coalesce(positive, F.lit(False)).alias("p"), F.coalesce(negative, F.lit(False)).alias("q")).where(F.col("p") | F.col("q")), grid, by)
    # thresholds at or below s: the guess by division, set right by comparing with its neighbours
    guess = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("s") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (n - 1))).otherwise(n - 1).cast("int")
    rows = rows.withColumn("g", F.greatest(F.lit(0), F.least(F.lit(n - 1), guess)))
    at = lambda k: F.get("ts", F.col("g") + k)
    below = F.col("g") + F.when(at(1) <= F.col("s"), F.when(at(2) <= F.col("s"), 3).otherwise(2)).when(at(0) <= F.col("s"), 1).when(at(-1) <= F.col("s"), 0).otherwise(-1)
    below = F.when(F.col("hi") == F.col("lo"), n).otherwise(below)
    counts = rows.groupBy(*by, below.alias("below")).agg(F.sum(F.col("p").cast("long")).alias("p"), F.sum(F.col("q").cast("long")).alias("q"))
    # at threshold i a score counts as predicted if more than i thresholds are at or below it
    t, c = th.alias("t"), counts.alias("c")
    same = F.lit(True)
    for k in by:
        same &= F.col(f"t.{k}") == F.col(f"c.{k}")
    joined = t.join(c if by else F.broadcast(c), same, "left").groupBy(*[F.col(f"t.{k}").alias(k) for k in by], "t.i", "t.t", "t.lo", "t.hi")
    hit = F.col("c.below") > F.col("t.i")
    total = lambda x, cond: F.coalesce(F.sum(F.when(cond, F.col(x))), F.lit(0)).cast("long")
    out = joined.agg(total("c.p", hit).alias("tp"), total("c.p", ~hit).alias("fn"), total("c.q", hit).alias("fp"), total("c.q", ~hit).alias("tn"))
    rate = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(0.0)
    return out.select("*", rate("fn", "tp").alias("fnr"), rate("fp", "tn").alias("fpr")).select("*", F.when(F.col("fp") + F.col("tn") > 0, 1 - F.col("fpr")).otherwise(0.0).alias("tnr"), F.when(F.col("fn") + F.col("tp") > 0, 1 - F.col("fnr")).otherwise(0.0).alias("tpr"))


def estimate(preds: DataFrame, rates: DataFrame, n: int = 250, score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """preds with fnr_est, fpr_est, tnr_est, tpr_est: the curve at each score, linear between thresholds, within [0, 1].

    Thresholds are evenly spaced, so the piece of the curve is found by division and an equi join with n rows.
    """
    pieces = rates.select(*by, F.col("i").alias("__i"), F.col("t").alias("__t"), "lo", "hi", *[F.col(r).alias(f"__{r}") for r in RATES])
    after = rates.select(*by, (F.col("i") - 1).alias("__i"), F.col("t").alias("__t1"), *[F.col(r).alias(f"__{r}1") for r in RATES])
    pieces = pieces.join(after, [*by, "__i"], "left")
    ends = rates.groupBy(*by).agg(F.first("lo").alias("__lo"), F.first("hi").alias("__hi"))
    s = F.col(score).cast("double")
    place = F.when(F.col("__hi") > F.col("__lo"), F.floor((s - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * (n - 1))).otherwise(n - 1)
    rows = _attach(preds, ends, by).withColumn("__i", F.greatest(F.lit(0), F.least(F.lit(n - 1), place)).cast("int"))
    rows = rows.join(pieces if by else F.broadcast(pieces), [*by, "__i"])
    share = F.when(F.col("__t1") > F.col("__t"), (s - F.col("__t")) / (F.col("__t1") - F.col("__t"))).otherwise(0.0)
    value = lambda r: F.col(f"__{r}") + share * (F.coalesce(f"__{r}1", f"__{r}") - F.col(f"__{r}"))
    return rows.select(*preds.columns, *[F.greatest(F.lit(0.0), F.least(F.lit(1.0), value(r))).alias(f"{r}_est") for r in RATES])


def error_rates(preds: DataFrame, n: int = 250, min_fnr: float = 0.5, max_fpr: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """Predictions with their estimated rates, those with fnr_est >= min_fnr and fpr_est <= max_fpr."""
    preds = materialize(preds, "predictions")
    return estimate(preds, materialize(curve(preds, n, by=by), "curve"), n, by=by).where((F.col("fnr_est") >= min_fnr) & (F.col("fpr_est") <= max_fpr))
