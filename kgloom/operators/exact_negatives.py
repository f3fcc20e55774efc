"""Negative triples, exactly as many as asked for, of the right types.

A positive's replacements are drawn by integer arithmetic, in rounds over the positives that still lack some. A node that is
linked to nearly all others would reject nearly every draw; its positives take theirs by rank from what isn't known:
the r-th number missing in a sorted list of known numbers is r plus how many known numbers k, the i-th of their list, have k - i <= r. Both
counts are running sums split across tasks, so no list of a node's partners is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.operators.scan import running_sums
from kgloom.schema import small
from kgloom.storage import materialize

ROUNDS = 4
POSITIVE = ["relation", "head", "tail"]


def _number(c: Column, side: int, seed: int) -> Column:
    """The c-th draw of a positive."""
    x = (F.col("head") * 7919 + F.col("tail") * 104729 + F.col("relation") * 1299709 + c * 15485863 + side * 49979687 + seed * 32452843) % 2147483647
    return (x * 48271) % 2147483647


def _spread(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if small(rows, 10_000) else rows


def demand(positives: DataFrame, known: DataFrame, sizes: DataFrame, n: int, which: str) -> DataFrame:
    """Each distinct positive with want_tail and want_head, the replacements of either side it gets, and with free_tail and free_head, those there are.

    `both` takes half from either side, the odd one a head; what one side lacks the other gives, if it can.
    """
    rows = positives.select(*POSITIVE).dropna().distinct().join(_spread(sizes.select("relation", "n_heads", "n_tails")), "relation")
    tails = known.groupBy("relation", "head").agg(F.count("*").alias("_tails"))
    heads = known.groupBy("relation", "tail").agg(F.count("*").alias("_heads"))
    rows = rows.join(tails, ["relation", "head"], "left").join(heads, ["relation", "tail"], "left")
    rows = rows.withColumns({"free_tail": F.col("n_tails") - F.coalesce("_tails", F.lit(0)), "free_head": F.col("n_heads") - F.coalesce("_heads", F.lit(0))})
    if which == "both":
        half = F.least(F.lit(n - n // 2), "free_head")
        rows = rows.withColumn("want_tail", F.least(F.lit(n) - half, "free_tail")).withColumn("want_head", F.least(F.lit(n) - F.col("want_tail"), "free_head"))
    else:
        rows = rows.withColumns({f"want_{s}": F.least(F.lit(n), f"free_{s}") if s == which else F.lit(0) for s in ("tail", "head")})
    return rows.drop("_tails", "_heads")


def _drawn(rows: DataFrame, known: DataFrame, side: int, seed: int) -> tuple[list[DataFrame], DataFrame]:
    """Tables of (positive, value) of the positives that the rounds satisfied, and the positives left. rows: positive, fixed, size, want, free."""
    done, lacking, held = [], rows, None
    for j in range(ROUNDS):
        tries = lacking.withColumn("c", F.explode(F.sequence(F.col("want") * j, F.col("want") * (j + 1) - 1)))
        tries = tries.select(*POSITIVE, "fixed", "want", "c", (_number(F.col("c"), side, seed) % F.col("size")).alias("value"))
        fresh = tries.join(known, ["relation", "fixed", "value"], "left_anti").select(*POSITIVE, "want", "c", "value")
        if held is not None:
            fresh = fresh.unionByName(held)
        first = Window.partitionBy(*POSITIVE).orderBy("c")
        fresh = fresh.groupBy(*POSITIVE, "want", "value").agg(F.min("c").alias("c")).withColumn("nth", F.row_number().over(first)).where("nth <= want")
        taken = materialize(fresh.withColumn("got", F.count("*").over(Window.partitionBy(*POSITIVE))).drop("nth"), "draws")
        done.append(taken.where("got = want").select(*POSITIVE, "value"))
        held = taken.where("got < want").drop("got")
        lacking = materialize(lacking.join(taken.where("got = want").select(*POSITIVE).distinct(), POSITIVE, "left_anti"), "lacking")
        if lacking.isEmpty():
            break
    return done, lacking


def by_rank(asked: DataFrame, known: DataFrame) -> DataFrame:
    """asked(relation, fixed, rank) with `value`, the number of that rank (from 0) among those that known(relation, fixed, value) hasn't."""
    keys = ["relation", "fixed"]
    mine = known.join(asked.select(*keys).distinct(), keys, "left_semi").distinct().withColumn("one", F.lit(1).cast("long"))
    placed = running_sums(mine, keys, "value", {"upto": "one"})
    marks = placed.select(*keys, (2 * (F.col("value") - F.col("upto") + 1)).alias("at"), F.lit(1).cast("long").alias("gap"), F.lit(None).cast("long").alias("rank"))
    wanted = asked.select(*keys, "rank").distinct().select(*keys, (2 * F.col("rank") + 1).alias("at"), F.lit(0).cast("long").alias("gap"), F.col("rank").cast("long").alias("rank"))
    found = running_sums(marks.unionByName(wanted), keys, "at", {"below": "gap"}).where("rank IS NOT NULL")
    return found.select(*keys, "rank", (F.col("rank") + F.col("below")).alias("value"))


def corrupted_exactly(positives: DataFrame, known: DataFrame, sizes: DataFrame, n: int, which: str = "both", seed: int = 42) -> DataFrame:
    """relation, head, tail, neg_head, neg_tail: n negatives of each distinct positive, or all there are if there are fewer; none is known, none comes twice.

    positives and known are (relation, head, tail), sizes is (relation, n_heads, n_tails): nodes of a type are numbered from 0, so
    replacements are of the replaced node's type. A positive counts as known whether it's listed there or not.
    """
    if which not in ("head", "tail", "both"):
        raise ValueError(f"unknown side {which}")
    taken = materialize(known.select(*POSITIVE).unionByName(positives.select(*POSITIVE)).dropna().distinct(), "known")
    wants = materialize(demand(positives, taken, sizes, n, which), "demand")
    out = []
    for side, (fixed, moved) in enumerate((("head", "tail"), ("tail", "head"))):
        rows = wants.select(*POSITIVE, F.col(fixed).alias("fixed"), F.col(f"n_{moved}s").alias("size"), F.col(f"want_{moved}").alias("want"), F.col(f"free_{moved}").alias("free")).where("want > 0")
        links = taken.select("relation", F.col(fixed).alias("fixed"), F.col(moved).alias("value"))
        done, lacking = _drawn(rows, links, side, seed)
        ranked = lacking.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("want").cast("long") - 1)))
        ranked = ranked.select(*POSITIVE, "fixed", ((_number(F.lit(0).cast("long"), side, seed) + F.col("c")) % F.col("free")).alias("rank"))
        done.append(ranked.join(by_rank(ranked, links), ["relation", "fixed", "rank"]).select(*POSITIVE, "value"))
        for part in done:
            value = part.select(*POSITIVE, F.col("value").alias(f"neg_{moved}"), F.col(fixed).alias(f"neg_{fixed}"))
            out.append(value.select(*POSITIVE, "neg_head", "neg_tail"))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole
