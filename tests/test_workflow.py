import pytest
from pyspark.sql import functions as F

from kgloom.plans import workflow


def test_from_raw_tables_to_folds(spark):
    assays = spark.createDataFrame(
        [(f"d{i}", f"g{(i + j) % 7}", "Kd", 10.0 * j, "TIER_1", "=", "src") for i in range(6) for j in range(4)] + [("d0", "g0", "IC50", 1.0, "TIER_1", "=", "src"), ("d0", None, "Kd", 1.0, "TIER_1", "=", "src"), ("d1", "g6", "Kd", 5000.0, "TIER_1", "=", "src")],
        "inchikey string, gene_symbol string, assay_type string, assay_value double, tier string, assay_relation string, file_source string",
    )
    meta, target = workflow.target_relation(assays)
    assert meta.count() == target.count() == 24 and target.first().relation == "targets"
    genes = spark.createDataFrame([("g1", "D1", None), ("g2", "D1", "marker"), ("g3", "D2", "marker")], "gene string, disease string, evidence string")
    assoc = workflow.association_relation(genes, "gene", "disease", "gene", "disease", "associates", "evidence", genes.where("disease = 'D1'"))
    assert sorted((r.src, r.relation) for r in assoc.collect()) == [("D1", "associates_rev"), ("g2", "associates_fwd")]
    ppi = spark.createDataFrame([("g1", "g2", True, None), ("g2|x", "g3", True, True), ("g4", "g5", False, False)], "source string, target string, consensus_stimulation boolean, consensus_inhibition boolean")
    inter = workflow.interaction_relations(ppi)
    assert inter.count() == 8 and inter.where("src = 'g2' AND relation = 'stimulates_fwd'").count() == 1
    edges = target.unionByName(assoc).unionByName(inter)
    nodes, rels, triples = workflow.assemble(edges, k_folds=4)
    assert rels.count() == 9
    per = triples.groupBy("fold").agg(F.count("*").alias("n"), F.sum((F.col("split") == "test").cast("int")).alias("test"))
    assert [(r.n, r.test) for r in per.orderBy("fold").collect()] == [(34, 6)] * 4
    assert triples.where("split <> 'train' AND head_type <> 'drug'").count() == 0
    swept = dict(workflow.ablation_sweep(triples.where("fold = 0"), rels, lambda t: t.select("relation").distinct()))
    assert len(swept) == 9 and all(d.where(F.col("relation") == k).count() == 0 for k, d in list(swept.items())[:2])
    with pytest.raises(ValueError):
        workflow.assemble(edges, ("drug", "none", "gene"))


def test_similarity_and_perturbation(spark):
    items = spark.createDataFrame([("a", "CCOCCO"), ("b", "CCOCCN"), ("c", "NNNNNN"), (None, "x")], "name string, smiles string")
    knn = workflow.similarity_relation(items, "name", "smiles", "drug", "similar", k=1)
    assert ("a", "b") in {(r.src, r.dst) for r in knn.collect()} and knn.count() == 3
    top = workflow.similarity_relation(items, "name", "smiles", "drug", "similar", "threshold", quantile=0.5)
    assert {(r.src, r.dst) for r in top.collect()} == {("a", "b"), ("b", "a")}
    sig = spark.createDataFrame([("s1", "p1", 10.0, 24.0, 1, "A"), ("s2", "p1", 10.0, 24.0, 1, "A"), ("s3", "p1", 5.0, 24.0, 1, "A")], "sig_id string, pert_id string, pert_dose double, pert_time double, is_exemplar_sig int, cell_iname string")
    cells = spark.createDataFrame([("s1", "1", -9.0), ("s1", "2", -8.0), ("s2", "2", -20.0)], "sig_id string, gene_id string, value double")
    out = workflow.perturbation_relations(sig, spark.createDataFrame([("p1", "KEY")], "pert_id string, inchi_key string"), spark.createDataFrame([(1, "G1"), (2, "G2")], "gene_id long, gene_symbol string"), cells, ["A"])
    assert sorted((r.src, r.dst, r.relation) for r in out.collect()) == [("G1", "KEY", "A_lincs_perturbation_rev"), ("KEY", "G1", "A_lincs_perturbation_fwd")]


def test_predictions(spark):
    pos = spark.createDataFrame([(i, i) for i in range(5)], "head long, tail long")
    scored = workflow.predict_with_negatives(pos, pos, lambda d: d.withColumn("score", (10 - F.abs(F.col("head") - F.col("tail"))).cast("double")), 3, 5, 9)
    assert scored.where("y = 1").count() == 5 and scored.where("y = 0").count() > 5 and scored.agg(F.max("prob")).first()[0] == 1.0
    rows = [(d, p, f, float(d + p + f) / 10, p == 0, p > 1) for d in range(3) for p in range(6) for f in range(2)]
    preds = spark.createDataFrame(rows, "drug long, protein long, fold int, score double, test boolean, negatives boolean")
    out = workflow.aggregate_folds(preds, [spark.createDataFrame([(0, "zero")], "drug long, name string")], 20, 0.0, 1.0, 2)
    assert out.count() == 18 and out.first().in_n_folds == 2 and out.where("name = 'zero'").count() == 6
    known = spark.createDataFrame([(0, 0, 5.0), (1, 1, None)], "drug long, protein long, assay_value double")
    assert workflow.novel_predictions(out, known, ["drug", "protein"]).count() == 17
    row = workflow.evaluate(preds.withColumn("prob", F.col("score"))).first()
    assert 0 < row.mrr <= 1
    assert workflow.triple_key("drug, targets ,gene") == ("drug", "targets", "gene")
    with pytest.raises(ValueError):
        workflow.triple_key("drug,targets")
