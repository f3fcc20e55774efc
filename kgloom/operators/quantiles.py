"""Exact quantiles without a sort and without gathering a group: radix selection.

Every value falls into a bin by a function that never falls as values rise: first by sign, binary exponent and the next bits of
the number, then by even steps between the least and the greatest value of the bin at hand. Each round counts the rows of each key's open bins, partially
in every task, finds for each wanted rank the bin that holds it, and goes on inside that bin alone, until it holds one
value or few rows. A task holds counts of at most BINS bins for each key and rank, never a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.schema import small
from kgloom.storage import drop_table, materialize

#: Steps to a power of two in the first round, steps in later ones, and rows that are sorted at last.
OCTAVE, BINS, FEW = 16, 4096, 1000


def _leading(x: Column) -> Column:
    """A bin by sign, exponent and leading bits; zero is bin 0."""
    size = F.floor((F.log2(F.abs(x)) + 1080) * OCTAVE).cast("long") + 1
    return F.when(x == 0, F.lit(0).cast("long")).when(x > 0, size).otherwise(-size)


def _attach(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join by keys, null keys matching null keys; the right side is broadcast behind a check of its size."""
    renamed = right.select(*[F.col(c).alias(f"__k{keys.index(c)}") if c in keys else F.col(c) for c in right.columns])
    renamed = F.broadcast(renamed) if small(renamed, 50_000) else renamed
    same = F.lit(True)
    for n, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{n}"))
    return left.join(renamed, same).drop(*[f"__k{n}" for n in range(len(keys))])


def selected(df: DataFrame, value: str, ranks: DataFrame, by: list[str]) -> DataFrame:
    """ranks(by..., rank) with `found`, the value of that rank (from 0) among the key's values that aren't null and not NaN. Ranks are distinct for each key and lie within its rows."""
    x = F.col(value).cast("double")
    rows = df.select(*by, x.alias("__x")).where(F.col("__x").isNotNull() & ~F.isnan("__x"))
    state = ranks.select(*by, "rank", F.lit(0).cast("long").alias("__before"), F.lit(None).cast("double").alias("__lo"), F.lit(None).cast("double").alias("__hi"), F.lit(None).cast("long").alias("__n"))
    state, out, first = materialize(state, "ranks"), [], True
    while True:
        # several ranks of a key may look into one bin, which is counted once
        open_ = state.select(*by, "__lo", "__hi").distinct()
        near = _attach(rows, open_, by) if by else rows.join(F.broadcast(open_), F.lit(True))
        inside = near if first else near.where(F.col("__x").between(F.col("__lo"), F.col("__hi")))
        step = F.floor((F.col("__x") / 2 - F.col("__lo") / 2) / (F.col("__hi") / 2 - F.col("__lo") / 2) * BINS)
        bin_ = _leading(F.col("__x")) if first else F.least(step.cast("long"), F.lit(BINS - 1))
        counts = inside.groupBy(*by, "__lo", "__hi", bin_.alias("__bin")).agg(F.count("*").alias("__c"), F.min("__x").alias("__l"), F.max("__x").alias("__h"))
        upto = Window.partitionBy(*by, "__lo", "__hi").orderBy("__bin")
        counts = counts.withColumn("__b", F.sum("__c").over(upto) - F.col("__c"))
        bins = counts.select(*[F.col(k).alias(f"__q{n}") for n, k in enumerate(by)], F.col("__lo").alias("__p"), F.col("__hi").alias("__q"), "__c", "__l", "__h", "__b")
        at = F.col("__lo").eqNullSafe(F.col("__p")) & F.col("__hi").eqNullSafe(F.col("__q"))
        for n, k in enumerate(by):
            at &= F.col(k).eqNullSafe(F.col(f"__q{n}"))
        inner = F.col("rank") - F.col("__before")
        hit = state.join(bins, at).where((inner >= F.col("__b")) & (inner < F.col("__b") + F.col("__c")))
        hit = materialize(hit.select(*by, "rank", (F.col("__before") + F.col("__b")).alias("__before"), F.col("__l").alias("__lo"), F.col("__h").alias("__hi"), F.col("__c").alias("__n")), "ranks")
        drop_table(state)
        out.append(hit.where("__lo = __hi").select(*by, "rank", F.col("__lo").alias("found")))
        few = hit.where(f"__lo < __hi AND __n <= {FEW}")
        if not few.isEmpty():
            spans = few.select(*by, "__lo", "__hi").distinct()
            last = (_attach(rows, spans, by) if by else rows.join(F.broadcast(spans), F.lit(True))).where(F.col("__x").between(F.col("__lo"), F.col("__hi")))
            lists = last.groupBy(*by, "__lo", "__hi").agg(F.sort_array(F.collect_list("__x")).alias("__all"))
            lists = lists.select(*[F.col(k).alias(f"__q{n}") for n, k in enumerate(by)], F.col("__lo").alias("__p"), F.col("__hi").alias("__q"), "__all")
            picked = few.join(lists, at).select(*by, "rank", F.element_at("__all", (F.col("rank") - F.col("__before") + 1).cast("int")).alias("found"))
            out.append(materialize(picked, "found"))
        state, first = hit.where(f"__lo < __hi AND __n > {FEW}"), False
        if state.isEmpty():
            break
        state = materialize(state, "ranks")
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def quantiles(df: DataFrame, value: str, qs: list[float], by: list[str] = ()) -> DataFrame:
    """by..., q, value: each key's exact quantiles, linear between neighbours. Null and NaN values don't count; keys without values have no rows, null keys are a key.

    One pass counts, then a pass for each round; two rounds do for most data.
    """
    by = list(by)
    x = F.col(value).cast("double")
    counts = df.where(x.isNotNull() & ~F.isnan(x)).groupBy(*by).agg(F.count("*").alias("__n")).where("__n > 0")
    wanted = counts.select(*by, "__n", F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q")).withColumn("__at", F.col("q") * (F.col("__n") - 1))
    wanted = materialize(wanted.select(*by, "q", F.col("__at"), F.floor("__at").alias("__low"), F.ceil("__at").alias("__high")), "wanted")
    ranks = wanted.select(*by, F.explode(F.array("__low", "__high")).alias("rank")).distinct()
    found = materialize(selected(df, value, ranks, by), "found")
    side = lambda name: found.select(*[F.col(k).alias(f"__{name}{n}") for n, k in enumerate(by)], F.col("rank").alias(f"__{name}"), F.col("found").alias(f"__{name}_value"))
    out = wanted
    for name in ("low", "high"):
        other = side(name).withColumnRenamed(f"__{name}", "__rank")
        same = F.col(f"__{name}") == F.col("__rank")
        for n, k in enumerate(by):
            same &= F.col(k).eqNullSafe(F.col(f"__{name}{n}"))
        out = out.join(other, same).drop("__rank", *[f"__{name}{n}" for n in range(len(by))])
    between = (F.col("__high") - F.col("__at")) * F.col("__low_value") + (F.col("__at") - F.col("__low")) * F.col("__high_value")
    return out.select(*by, "q", F.when(F.col("__low_value") == F.col("__high_value"), F.col("__low_value")).otherwise(between).alias("value"))
