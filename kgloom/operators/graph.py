"""Typed graphs as tables: node and relation dictionaries, indexed edges, statistics, folds and triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgloom.operators.relations import exclude_relations
from kgloom.schema import position
from kgloom.storage import materialize

_KEY = ["src_type", "relation", "dst_type"]


def node_dictionary(edges: DataFrame) -> DataFrame:
    """node_type, name, idx: names of each type in order, numbered from 0.

    Places are counted over the whole sorted dictionary and taken relative to the type's first, so a
    type with most of the nodes is still numbered by many tasks.
    """
    known = edges.dropna(subset=["src", "dst"])
    names = known.select(F.col("src_type").alias("node_type"), F.col("src").alias("name")).union(known.select("dst_type", "dst")).distinct()
    placed = position(names, "node_type", "name")
    first = placed.groupBy("node_type").agg(F.min("pos").alias("first"))
    return placed.join(first, "node_type").select("node_type", "name", (F.col("pos") - F.col("first")).alias("idx"))


def relation_dictionary(edges: DataFrame) -> DataFrame:
    """rel_id and edge type, in order of the key. There are few edge types."""
    types = edges.dropna(subset=["src", "dst"]).select(*_KEY).distinct()
    return types.withColumn("rel_id", (F.row_number().over(Window.orderBy(*_KEY)) - 1).cast("long"))


def indexed_edges(edges: DataFrame, nodes: DataFrame, relations: DataFrame, keep_duplicates: bool = False) -> DataFrame:
    """rel_id, src_idx, dst_idx."""
    known = edges.dropna(subset=["src", "dst"]).select("src", "dst", *_KEY)
    known = known if keep_duplicates else known.distinct()
    side = lambda s: nodes.select(F.col("node_type").alias(f"{s}_type"), F.col("name").alias(s), F.col("idx").alias(f"{s}_idx"))
    return known.join(relations, _KEY).join(side("src"), ["src_type", "src"]).join(side("dst"), ["dst_type", "dst"]).select("rel_id", "src_idx", "dst_idx")


def build(edges: DataFrame, keep_duplicates: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, relations and indexed edges."""
    nodes, relations = materialize(node_dictionary(edges), "nodes"), materialize(relation_dictionary(edges), "relations")
    return nodes, relations, indexed_edges(edges, nodes, relations, keep_duplicates)


def edge_type_stats(edges: DataFrame) -> DataFrame:
    """Edges and distinct ends of each edge type."""
    return edges.dropna(subset=["src", "dst"]).groupBy(*_KEY).agg(F.count("*").alias("n_edges"), F.count_distinct("src").alias("n_src"), F.count_distinct("dst").alias("n_dst"))


def graph_stats(nodes: DataFrame, indexed: DataFrame) -> DataFrame:
    """One row: totals, and maps of counts by node type and relation."""
    by_type = nodes.groupBy("node_type").agg(F.count("*").alias("n"))
    by_rel = indexed.groupBy("rel_id").agg(F.count("*").alias("n"))
    gather = lambda d, k, m: d.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(f"n_{m}"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, "n")))).alias(f"{m}_counts"))
    return gather(by_type, "node_type", "node").crossJoin(gather(by_rel, "rel_id", "edge"))


def with_folds(pairs: DataFrame, order: list[str], k: int, step: int = 7, start: int = 0) -> DataFrame:
    """pairs with `pos` in the order and `fold`: (pos * step) mod k, so folds differ by one row at most where step and k share no factor."""
    return position(pairs, *order).withColumn("fold", ((F.col("pos") * step + start) % k).cast("int"))


def split_of_fold(folded: DataFrame, fold: int, val_prop: float = 0.075, scale: int = 1000, step: int = 389) -> DataFrame:
    """split: test for the fold; of the others, valid for a stable share of about val_prop, else train."""
    valid = (F.col("pos") * step) % scale < int(val_prop * scale)
    return folded.withColumn("split", F.when(F.col("fold") == fold, "test").when(valid, "valid").otherwise("train"))


def all_splits(folded: DataFrame, k: int, **how) -> DataFrame:
    """The splits of all folds: `of_fold` says whose split a row shows. Folds are a column; nothing is rebuilt."""
    rows = folded.withColumn("of_fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    val_prop, scale, step = how.get("val_prop", 0.075), how.get("scale", 1000), how.get("step", 389)
    valid = (F.col("pos") * step) % scale < int(val_prop * scale)
    return rows.withColumn("split", F.when(F.col("fold") == F.col("of_fold"), "test").when(valid, "valid").otherwise("train"))


def triples(indexed: DataFrame, relations: DataFrame, target: int, split: DataFrame) -> DataFrame:
    """All triples with their split: the target relation's by (src_idx, dst_idx), all others train."""
    named = indexed.join(relations, "rel_id")
    found = named.join(split.select("src_idx", "dst_idx", "split").withColumn("rel_id", F.lit(target).cast("long")), ["rel_id", "src_idx", "dst_idx"], "left")
    return found.select(
        F.coalesce("split", F.lit("train")).alias("split"), F.col("src_type").alias("head_type"), F.col("src_idx").alias("head"), F.col("rel_id").alias("relation"), F.col("dst_type").alias("tail_type"), F.col("dst_idx").alias("tail")
    )


def message_graph(triples_: DataFrame) -> DataFrame:
    """What a model may see: training triples only."""
    return triples_.where("split = 'train'")


def ablate(triples_: DataFrame, relation: int) -> DataFrame:
    """The triples without one relation."""
    return triples_.where(F.col("relation") != relation)


def of_relations(triples_: DataFrame, wanted: list[int]) -> DataFrame:
    """The triples of the listed relations."""
    return triples_.where(F.col("relation").isin(wanted))


def leave_one_out(edges: DataFrame, pairs: DataFrame, head: str, tail: str) -> DataFrame:
    """Edges without the examples at hand."""
    return edges.join(pairs.select(head, tail).distinct(), [head, tail], "left_anti")


def select_relations(edges: DataFrame, deny: list[str], node_types: list[str], no_rev: bool = False) -> DataFrame:
    return exclude_relations(edges, deny, node_types, "_rev" if no_rev else None)
