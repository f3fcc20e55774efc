"""Whole steps, from raw tables to novel predictions, as functions with the usual defaults."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.operators import aggregate, embed, errorrate, exact_negatives, graph, metrics, relations, similarity, simjoin
from kgloom.schema import first_known


def target_relation(assays: DataFrame, assay_types: Sequence[str] = ("Kd", "Ki"), max_assay_value: float = 1000.0, tiers: Sequence[str] = ("TIER_1",), default_tier: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Metadata and edges of drug-targets-gene.

    assays: inchikey, gene_symbol, assay_type, assay_value, tier[, assay_relation] and any metadata columns. Duplicate
    metadata rows go; edges keep one row per distinct metadata row, unless made distinct by the caller.
    """
    sign = "assay_relation" if "assay_relation" in assays.columns else None
    kept = relations.target_filter(assays, "tier", tiers, "assay_type", assay_types, "assay_value", max_assay_value, sign, default_tier=default_tier)
    meta = kept.dropna(subset=["inchikey", "gene_symbol"]).drop("assay_type", "assay_value", "tier", "assay_relation").distinct()
    return meta, relations.edges(meta, "inchikey", "gene_symbol", "drug", "gene", "targets", keep_duplicates=True)


def similarity_relation(items: DataFrame, id_col: str, text_col: str, node_type: str, relation: str, method: str = "knn", k: int = 3, quantile: float = 0.95, dim: int = 64, least: float = 0.8) -> DataFrame:
    """Edges between similar items: the k nearest of each (knn), pairs above the quantile of all cosines (threshold), or pairs whose cosine is over `least` (cosine).

    The last two give edges in both directions; the last one compares only pairs that pivots leave.
    """
    vectors = embed.hashed_embedding(items.dropna(subset=[id_col]), id_col, text_col, dim).withColumnRenamed("id", "name")
    numbered = vectors.withColumn("id", F.xxhash64("name"))
    if method == "knn":
        pairs = similarity.cosine_knn(numbered, k).select("i", "j")
    elif method == "threshold":
        pairs = relations.symmetric_closure(similarity.cosine_above_quantile(numbered, quantile), "i", "j")
    elif method == "cosine":
        pairs = relations.symmetric_closure(simjoin.all_pairs(simjoin.exact_join(numbered, least)), "i", "j")
    else:
        raise ValueError(f"unknown method {method}")
    named = lambda n: numbered.select(F.col("id").alias(n), F.col("name").alias(f"{n}_name"))
    return relations.edges(pairs.join(named("i"), "i").join(named("j"), "j"), "i_name", "j_name", node_type, node_type, relation)


def association_relation(rows: DataFrame, src: str, dst: str, src_type: str, dst_type: str, relation: str, evidence: str | None = None, space: DataFrame | None = None) -> DataFrame:
    """Forward and reversed edges of an association file; only rows with evidence, and targets of the space, if given."""
    rows = rows.where(F.col(evidence).isNotNull()) if evidence else rows
    rows = relations.keep_keys_if(rows, space, dst)
    return relations.with_reverse(relations.edges(rows, src, dst, src_type, dst_type, f"{relation}_fwd"))


def interaction_relations(rows: DataFrame, source: Sequence[str] = ("source_genesymbol", "source_genesymbols", "source"), target: Sequence[str] = ("target_genesymbol", "target_genesymbols", "target")) -> DataFrame:
    """gene-{stimulates, inhibits, interacts}-gene edges in both directions, duplicates kept."""
    named = rows.withColumns({"__s": relations.first_symbol(rows, source), "__t": relations.first_symbol(rows, target)})
    flagged = relations.flag_partition(named, "consensus_stimulation", "consensus_inhibition").dropna(subset=["__s", "__t"])
    edges = flagged.select(F.col("__s").alias("src"), F.col("__t").alias("dst"), F.lit("gene").alias("src_type"), F.lit("gene").alias("dst_type"), F.concat("relation", F.lit("_fwd")).alias("relation"))
    return relations.with_reverse(edges)


def perturbation_relations(signatures: DataFrame, compounds: DataFrame, genes: DataFrame, cells: DataFrame, cell_lines: Sequence[str], score_threshold: float = 8.0, sign: str = "-", dose: float = 10.0, time: float = 24.0) -> DataFrame:
    """drug-<cell>_lincs_perturbation-gene edges in both directions.

    The first exemplar signature of each compound and cell line (by sig_id) is used; cells are (sig_id, gene_id, value).
    """
    wanted = signatures.where((F.col("pert_dose") == dose) & (F.col("pert_time") == time) & (F.col("is_exemplar_sig") == 1) & F.col("cell_iname").isin(list(cell_lines)))
    wanted = wanted.dropna(subset=["pert_id", "cell_iname"]).groupBy("pert_id", "cell_iname").agg(first_known("sig_id", "sig_id").alias("sig_id"))
    drugs = compounds.dropna().groupBy("pert_id").agg(F.min("inchi_key").alias("inchi_key"))
    beyond = relations.signature_edges(cells.join(wanted.select("sig_id"), "sig_id", "left_semi"), score_threshold, sign)
    rows = beyond.join(wanted, "sig_id").join(drugs, "pert_id").join(genes.select(F.col("gene_id").cast("string").alias("gene_id"), "gene_symbol"), "gene_id")
    edges = rows.select(
        F.col("inchi_key").alias("src"), F.col("gene_symbol").alias("dst"), F.lit("drug").alias("src_type"), F.lit("gene").alias("dst_type"), F.concat("cell_iname", F.lit("_lincs_perturbation_fwd")).alias("relation")
    )
    return relations.with_reverse(edges.dropna().distinct())


def strong_binding_relation(predictions: DataFrame, q_strong: float = 0.95, q_weak: float = 0.05, drop: str = "MIR") -> DataFrame:
    """Edges of predicted strong binding: scores above the strong quantile whose lower bound is, too."""
    rows = relations.drop_prefix(predictions, "gene_symbol", drop).dropna(subset=["inchikey", "gene_symbol"])
    flags = aggregate.quantile_flags(aggregate.quantile_flags(rows, "kd_score", q_weak, q_strong).withColumnRenamed("is_strong", "strong").drop("is_weak"), "kd_lcb", q_weak, q_strong)
    return relations.with_reverse(relations.edges(flags.where("strong AND is_strong"), "inchikey", "gene_symbol", "drug", "gene", "predicted_strong_binding_fwd"))


def assemble(edges: DataFrame, target: tuple[str, str, str] = ("drug", "targets", "gene"), k_folds: int = 10, val_prop: float = 0.075, deny: Sequence[str] = (), exclude_types: Sequence[str] = ("patient",), no_rev: bool = False):
    """Nodes, relations and the triples of all folds: (fold, split, triple columns). Folds are a column; the graph is built once."""
    nodes, rels, indexed = graph.build(graph.select_relations(edges, list(deny), list(exclude_types), no_rev))
    key = rels.where((F.col("src_type") == target[0]) & (F.col("relation") == target[1]) & (F.col("dst_type") == target[2])).first()
    if key is None:
        raise ValueError(f"no edges of {target}")
    own = indexed.where(F.col("rel_id") == key.rel_id).select(F.col("src_idx").alias("head"), F.col("dst_idx").alias("tail"))
    splits = graph.all_splits(graph.with_folds(own, ["head", "tail"], k_folds), k_folds, val_prop=val_prop)
    shape = lambda d: d.select("fold", "split", "head_type", "head", "relation", "tail_type", "tail")
    target_rows = splits.select(F.col("of_fold").alias("fold"), "split", "head", "tail", F.lit(target[0]).alias("head_type"), F.lit(target[2]).alias("tail_type"), F.lit(key.rel_id).alias("relation"))
    others = graph.triples(indexed.where(F.col("rel_id") != key.rel_id), rels, key.rel_id, own.select(F.col("head").alias("src_idx"), F.col("tail").alias("dst_idx"), F.lit("train").alias("split")))
    others = others.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k_folds - 1))))
    return nodes, rels, shape(target_rows).unionByName(shape(others))


def predict_with_negatives(positives: DataFrame, known: DataFrame, score: Callable[[DataFrame], DataFrame], n: int, n_heads: int, n_tails: int, which: str = "both") -> DataFrame:
    """head, tail, score, y, prob: positives and n negatives for each of them (all there are, if there are fewer), scored; prob scaled over all."""
    one = lambda d: d.select(F.lit(0).cast("long").alias("relation"), F.col("head").cast("long").alias("head"), F.col("tail").cast("long").alias("tail"))
    sizes = positives.sparkSession.range(1).select(F.col("id").alias("relation"), F.lit(n_heads).cast("long").alias("n_heads"), F.lit(n_tails).cast("long").alias("n_tails"))
    wrong = exact_negatives.corrupted_exactly(one(positives), one(known), sizes, n, which).select(F.col("neg_head").alias("head"), F.col("neg_tail").alias("tail")).distinct()
    rows = score(positives.select("head", "tail").withColumn("y", F.lit(1)).unionByName(wrong.withColumn("y", F.lit(0))))
    return aggregate.min_max(rows, "score")


def ablation_sweep(triples: DataFrame, rels: DataFrame, run: Callable[[DataFrame], DataFrame]) -> Iterator[tuple[int, DataFrame]]:
    """The result of `run` on the triples without each relation in turn."""
    for r in rels.select("rel_id").orderBy("rel_id").toLocalIterator():
        yield r.rel_id, run(graph.ablate(triples, r.rel_id))


def aggregate_folds(preds: DataFrame, names: Sequence[DataFrame] = (), n_thresholds: int = 250, min_fnr: float = 0.5, max_fpr: float = 1.0, min_n_folds: int = 1) -> DataFrame:
    """Error rates of each fold's predictions, put together per pair, with metadata, best mean score first.

    preds: drug, protein, fold, score, test, negatives. names: metadata tables that share a column with the pairs.
    """
    if preds.isEmpty():
        raise ValueError("no predictions")
    out = aggregate.over_folds(errorrate.error_rates(preds, n_thresholds, min_fnr, max_fpr, by=["fold"]), min_folds=min_n_folds)
    for meta in names:
        out = aggregate.enrich(out, meta, next(c for c in ("drug", "protein") if c in meta.columns))
    return out.orderBy(F.desc("score_mean"))


def novel_predictions(predictions: DataFrame, known: DataFrame, keys: Sequence[str] = ("inchikey", "uniprot_id"), evidence: str = "assay_value") -> DataFrame:
    """Predictions whose pair has no measured value; null keys match null keys."""
    return relations.known_pairs_removed(predictions, known, list(keys), evidence)


def evaluate(preds: DataFrame, partition: str = "test", method: str = "all", ece_bins: int = 10) -> DataFrame:
    """One row of metrics of a prediction table (drug, score, prob, train, valid, test, negatives).

    Known pairs of other partitions count neither as positives nor as negatives.
    """
    rows = preds.where(F.coalesce(partition, F.lit(False)) | F.coalesce("negatives", F.lit(False)))
    return metrics.evaluate(rows.select(F.col("drug").alias("head"), "score", "prob", F.coalesce(partition, F.lit(False)).cast("int").alias("y")), method, ece_bins)


def triple_key(text: str) -> tuple[str, str, str]:
    """The key that a text of head,relation,tail names."""
    parts = tuple(p.strip() for p in text.split(","))
    if len(parts) != 3 or not all(parts):
        raise ValueError(f"not head,relation,tail: {text!r}")
    return parts
