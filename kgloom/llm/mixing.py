"""Mixing sources to target weights by entropy balancing. DataFrame operations only.

Each document gets a rate, how often the mix takes it on average. Of all rates between 0 and CAP that take a source's
target number of words, those nearest to "every document once" in relative entropy are tilted exponentials of the
document's size: rate = min(CAP, exp(lambda size)), with one multiplier for each source. The multipliers maximise a concave dual,
whose gradient is the words taken less the target; Newton steps on it are distributed sums, kept inside a bracket that shrinks
with each step. The documents of one source and size share a rate, so all of this runs over classes (source, size,
number), aggregated once; sources are rows too, so neither the driver nor a task sees them whole.

Rates become copies in two steps, both by class. Systematic rounding: going down the sizes of a source, a class takes the
whole copies that the running sum of rates passes, so the error is less than about one document. Then repair: as long as some
class of a source fits into the words that still lack (or are over), classes that fit take (or give back) copies, the longest documents
first; what stays is less than any document that could still be changed. Within a class the
copies are dealt out evenly, the odd ones to the first documents by a hash of the id; these places come from a distributed sort.

Defined results: a null text has size 0, and so have empty and blank ones; they are taken 0 times; a null source is a source of its own, last in the order; a
source without words has target 0; null and repeated ids are rows of their own; the copies of a class go to equal rows in any
order, so the result is the same table again; an empty table gives an empty result; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import drop_table, materialize, split_join
from kgloom.operators.scan import running_sums
from kgloom.schema import position, small

#: Weights of the sources in order, repeating; the mix's size over that of all documents; the most copies of a document.
WEIGHTS, SHARE, CAP = (5.0, 2.0, 1.0), 1.5, 2
#: Rates are rounded to multiples of 1 / UNIT, so that their running sums are exact in any order of addition.
UNIT = 1 << 32


def n_words(text: Column) -> Column:
    """The number of [^\\x20\\x09-\\x0D]+ in a text."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\x20\\x09-\\x0D]+", "x")
    return F.length(F.regexp_replace(marks, "[^x]+", "")).cast("long")


def _attach(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join on long keys; the right side, unique by them, is broadcast behind a check of its size, else hot keys are split."""
    return left.join(F.broadcast(right), keys, how) if small(right, 50_000) else split_join(left, right, keys, how)


def water_level(sources: DataFrame, budget: float) -> float:
    """The level t at which min(CAP total, t weight) over all sources adds up to the budget.

    Sources beyond their cap keep it and the excess is shared again, until none is above; only sums reach the driver.
    """
    level = 0.0
    while True:
        full = F.col("weight") * level > F.col("total") * CAP
        r = sources.agg(F.sum(F.when(full, F.col("total") * CAP).otherwise(0)).alias("held"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"), F.count(F.when(full, 1)).alias("n")).first()
        if not r.open:
            return level
        following = (budget - r.held) / r.open
        if following <= level * (1 + 1e-15):
            return max(level, following)
        level = following


def with_targets(sizes: DataFrame) -> DataFrame:
    """source, src (its place), total, target: one row for each source of sizes(source, size)."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("total")).withColumn("unknown", F.col("source").isNull())
    placed = position(totals, "unknown", "source", name="src").drop("unknown")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("src") % len(WEIGHTS)).cast("int") + 1)
    sources = materialize(placed.withColumn("weight", weight), "sources")
    budget = sources.agg(F.sum("total")).first()[0]
    level = water_level(sources, SHARE * budget) if budget else 0.0
    return sources.withColumn("target", F.least(F.lit(float(CAP)) * F.col("total"), F.lit(level) * F.col("weight"))).drop("weight")


def balance(classes: DataFrame, sources: DataFrame, tolerance: float = 1e-10, rounds: int = 100) -> DataFrame:
    """src, lam: the multiplier of each source, such that its classes(src, size, n) take its target words; null where every document is taken CAP times.

    With sizes of one word or more, the words taken are at most total exp(lambda) for lambda < 0 and all of CAP total from
    lambda = log CAP on, which brackets the multiplier. A step that leaves the bracket halves it.
    """
    top = math.log(CAP)
    state = sources.where("target > 0").select("src", "target", (F.col("target") >= F.col("total") * CAP).alias("full"), F.least(F.lit(0.0), F.log(F.col("target") / F.col("total"))).alias("lo"), F.lit(top).alias("hi"))
    state = materialize(state.withColumns({"lam": F.when(~F.col("full"), F.lit(0.0)), "settled": F.col("full")}), "multipliers")
    for _ in range(rounds):
        open_ = state.where("NOT settled").select("src", "lam")
        power = F.exp(F.least(F.col("lam") * F.col("size"), F.lit(top)))
        words = F.col("n") * F.col("size") * power
        sums = _attach(classes.where("size > 0"), open_, ["src"]).groupBy("src").agg(F.sum(words).alias("taken"), F.sum(F.when(F.col("lam") * F.col("size") < top, words * F.col("size")).otherwise(0.0)).alias("slope"))
        now = state.join(sums, "src", "left")
        over = F.col("taken") - F.col("target")
        lo, hi = F.when(over < 0, F.col("lam")).otherwise(F.col("lo")), F.when(over > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - over / F.when(F.col("slope") > 0, F.col("slope"))
        inside = (newton > F.col("_lo")) & (newton < F.col("_hi"))
        done = F.col("settled") | (F.abs(over) <= tolerance * F.col("target")) | (F.col("_hi") - F.col("_lo") <= 1e-15)
        now = now.withColumns({"_lo": lo, "_hi": hi}).withColumn("_done", done)
        step = F.when(F.col("_done"), F.col("lam")).otherwise(F.when(inside, newton).otherwise((F.col("_lo") + F.col("_hi")) / 2))
        after = materialize(now.select("src", "target", "full", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), step.alias("lam"), F.col("_done").alias("settled")).coalesce(8), "multipliers")
        drop_table(state)
        state = after
        if state.where("NOT settled").isEmpty():
            break
    return state.select("src", "lam")


def rounded(classes: DataFrame, multipliers: DataFrame) -> DataFrame:
    """classes with `copies`, the whole copies of all documents of a class, by systematic rounding down the sizes of each source."""
    rate = F.when(F.col("lam").isNull(), F.lit(float(CAP))).otherwise(F.least(F.lit(float(CAP)), F.exp(F.least(F.col("lam") * F.col("size"), F.lit(1.0)))))
    rated = _attach(classes.where("size > 0"), multipliers, ["src"]).withColumn("units", (F.floor(rate * UNIT + 0.5).cast("decimal(38,0)") * F.col("n")).cast("decimal(38,0)"))
    sums = running_sums(rated, ["src"], "size", {"upto": "units"}, descending=True)
    whole = lambda c: F.floor((c + UNIT // 2) / UNIT)
    return sums.select("src", "size", "n", (whole(F.col("upto")) - whole(F.col("upto") - F.col("units"))).cast("long").alias("copies"))


def repaired(classes: DataFrame, sources: DataFrame) -> DataFrame:
    """classes(src, size, n, copies) with copies changed until no class fits into what a source's words lack or are over.

    A round goes down the sizes that fit: each class changes as many copies as the words that larger ones leave. What then
    stays is less than the class at which the words ran out, so a few rounds do.
    """
    now = materialize(classes, "copies")
    while True:
        taken = now.groupBy("src").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"))
        lack = taken.join(sources.select("src", "target"), "src").select("src", (F.col("target") - F.col("taken")).cast("long").alias("lack")).where("lack <> 0")
        room = F.when(F.col("lack") > 0, F.col("n") * CAP - F.col("copies")).otherwise(F.col("copies"))
        fitting = _attach(now, materialize(lack.coalesce(8), "lacking"), ["src"]).withColumn("room", room).where("room > 0 AND size <= abs(lack)")
        summed = running_sums(fitting.withColumn("words", F.col("room") * F.col("size")), ["src"], "size", {"upto": "words"}, descending=True)
        left = F.expr("(abs(lack) - upto + words) div size")
        moved = F.least("room", left) * F.when(F.col("lack") > 0, 1).otherwise(-1)
        change = materialize(summed.where(left > 0).select("src", "size", moved.alias("moved")).coalesce(8), "changes")
        if change.isEmpty():
            return now
        after = materialize(_attach(now, change, ["src", "size"], "left").withColumn("copies", F.col("copies") + F.coalesce("moved", F.lit(0))).drop("moved"), "copies")
        drop_table(now)
        now = after


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, size, source_size, target, copies, taken: a row for each document."""
    sizes = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")), "sizes")
    sources = materialize(with_targets(sizes), "targets")
    named = sources.select(F.col("source").alias("_source"), "src")
    named = F.broadcast(named) if small(named, 50_000) else named
    rows = sizes.join(named, sizes["source"].eqNullSafe(F.col("_source"))).select("id", "src", "size")
    classes = materialize(rows.groupBy("src", "size").agg(F.count("*").alias("n")), "classes")
    multipliers = materialize(balance(classes, sources.where("total > 0")).coalesce(8), "balanced")
    copies = repaired(rounded(classes, multipliers), sources)
    placed = position(rows.withColumn("_deal", F.xxhash64("id")), "src", "size", "_deal", "id", name="_pos")
    first = placed.groupBy("src", "size").agg(F.min("_pos").alias("_first"), F.count("*").alias("n"))
    plan = materialize(first.join(copies.select("src", "size", "copies"), ["src", "size"], "left"), "class-copies")
    dealt = _attach(placed, plan, ["src", "size"])
    each = F.coalesce(F.floor(F.col("copies") / F.col("n")) + (F.col("_pos") - F.col("_first") < F.col("copies") % F.col("n")).cast("long"), F.lit(0))
    out = _attach(dealt.select("id", "src", "size", each.cast("long").alias("copies")), sources.select("src", "source", F.col("total").alias("source_size"), "target"), ["src"])
    return out.select("id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
