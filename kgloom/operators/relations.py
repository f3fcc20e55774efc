"""Building relations: filters, enrichment joins, reversed, partitioned and closed edge sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.schema import EDGE_COLUMNS, group_by_known, holds


def edges(df: DataFrame, src: str, dst: str, src_type: str, dst_type: str, relation: str, keep_duplicates: bool = False) -> DataFrame:
    """Rows in edge shape; rows without a source or target are left out."""
    out = df.select(F.col(src).cast("string").alias("src"), F.col(dst).cast("string").alias("dst")).dropna()
    out = out if keep_duplicates else out.distinct()
    return out.select("src", "dst", F.lit(src_type).alias("src_type"), F.lit(dst_type).alias("dst_type"), F.lit(relation).alias("relation"))


def target_filter(df: DataFrame, tier: str, tiers: Sequence, kind: str, kinds: Sequence, value: str, most: float, sign: str | None = None, signs: Sequence = ("=", "<", "<="), default_tier=None) -> DataFrame:
    """Rows of wanted tiers and assay kinds whose value is known to be at most `most` (inclusive)."""
    known = F.coalesce(F.col(tier), F.lit(default_tier)) if default_tier is not None else F.col(tier)
    keep = known.isin(list(tiers)) & F.col(kind).isin(list(kinds)) & (F.col(value) <= most)
    return df.where(keep & F.col(sign).isin(list(signs)) if sign else keep)


def keep_keys(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Semi join by a key set."""
    return df.join(keys.select(on).distinct(), on, "left_semi")


def keep_keys_if(df: DataFrame, keys: DataFrame | None, on: str) -> DataFrame:
    return df if keys is None else keep_keys(df, keys, on)


def drop_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose value doesn't start with the prefix; null values stay."""
    return df.where(~holds(F.col(column).startswith(prefix)))


def reversed_edges(df: DataFrame, forward: str = "_fwd", backward: str = "_rev") -> DataFrame:
    """Edges with their ends, types and relation suffix swapped."""
    relation = F.when(F.col("relation").endswith(forward), F.expr(f"left(relation, length(relation) - {len(forward)})")).otherwise(F.col("relation"))
    return df.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("dst_type").alias("src_type"), F.col("src_type").alias("dst_type"), F.concat(relation, F.lit(backward)).alias("relation"))


def with_reverse(df: DataFrame) -> DataFrame:
    return df.select(*EDGE_COLUMNS).unionByName(reversed_edges(df))


def symmetric_closure(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs and their reversals, once each."""
    return pairs.select(a, b).union(pairs.select(F.col(b).alias(a), F.col(a).alias(b))).distinct()


def missing_reverse(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs whose reversal isn't there: none for an undirected graph."""
    own = pairs.select(a, b).distinct()
    return own.join(own.select(F.col(b).alias(a), F.col(a).alias(b)), [a, b], "left_anti")


def flag_partition(df: DataFrame, stimulates: str, inhibits: str, names: tuple[str, str, str] = ("stimulates", "inhibits", "interacts")) -> DataFrame:
    """One row per relation that the flags give: either, both, or the third if neither. Null flags are false."""
    s, i = holds(F.col(stimulates)), holds(F.col(inhibits))
    of = F.array_compact(F.array(F.when(s, names[0]), F.when(i, names[1]), F.when(~s & ~i, names[2])))
    return df.withColumn("relation", F.explode(of))


def first_symbol(df: DataFrame, candidates: Sequence[str]) -> Column:
    """The first of the candidate columns that df has, and of a list or a|b text its first item."""
    name = next(c for c in candidates if c in df.columns)
    column = F.col(name)
    return F.element_at(column, 1) if dict(df.dtypes)[name].startswith("array") else F.split(column, r"\|")[0]


def known_pairs_removed(df: DataFrame, known: DataFrame, keys: Sequence[str], evidence: str | None = None) -> DataFrame:
    """Rows that aren't among the known pairs, null keys matching null keys; only pairs with evidence count as known."""
    known = known.where(F.col(evidence).isNotNull()) if evidence else known
    right = known.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    condition = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"__{k}"))
        condition = same if condition is None else condition & same
    return df.join(right, condition, "left_anti")


def exclude_relations(df: DataFrame, deny: Sequence[str] = (), node_types: Sequence[str] = (), reversed_suffix: str | None = None) -> DataFrame:
    """Edges without denied relations, edges of unwanted node types, and, if asked, reversed relations."""
    out = df.where(~holds(F.col("relation").isin(list(deny))) & ~holds(F.col("src_type").isin(list(node_types))) & ~holds(F.col("dst_type").isin(list(node_types))))
    return out.where(~holds(F.col("relation").contains(reversed_suffix))) if reversed_suffix else out


def signature_edges(cells: DataFrame, threshold: float, sign: str = "-") -> DataFrame:
    """Cells beyond the threshold: '-' below its negative, '+' above it, '+/-' either. Strict."""
    x = F.col("value")
    return cells.where({"-": x < -threshold, "+": x > threshold, "+/-": F.abs(x) > threshold}[sign])


def binarized(cells: DataFrame, threshold: float) -> DataFrame:
    return cells.withColumn("value", (F.col("value") > threshold).cast("int"))


def source_summary(df: DataFrame, source: str, *keys: str) -> DataFrame:
    """Rows and distinct keys for each source."""
    return group_by_known(df, source).agg(F.count("*").alias("n_rows"), *[F.count_distinct(k).alias(f"n_{k}") for k in keys])


def overlap(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: distinct keys of each side and of both."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    tagged = x.withColumn("__a", F.lit(1)).withColumn("__b", F.lit(0)).unionByName(y.withColumn("__a", F.lit(0)).withColumn("__b", F.lit(1)))
    each = tagged.groupBy(*keys).agg(F.max("__a").alias("a"), F.max("__b").alias("b"))
    return each.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for c, n in ((F.col("a"), "n_left"), (F.col("b"), "n_right"), (F.col("a") * F.col("b"), "n_both"))])
