import pytest

from kgloom.sources import readers, sinks


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_delimited_files(spark, tmp_path):
    a = put(tmp_path / "a.csv", "src,dst,src_type,dst_type,relation\nx,y,drug,gene,targets\n")
    b = put(tmp_path / "b.csv", "src,dst,src_type,dst_type,relation\ny,z,gene,gene,binds\n")
    edges = readers.relation_files(spark, [a, b])
    assert edges.count() == 2
    c = put(tmp_path / "c.csv", "# note\nTP53,7157,Cancer,D1,marker,,\n")
    assert readers.commented_csv(spark, c, readers.GENE_DISEASE).first().DiseaseID == "D1"
    t = put(tmp_path / "t.tsv", "sig_id\tvalue\ns1\t2.5\n")
    assert readers.tsv(spark, t, "sig_id string, value double").first().value == 2.5
    assert [r.name for r in readers.lines(spark, put(tmp_path / "l.txt", "one\n\n two \n")).collect()] == ["one", "two"]
    sinks.edge_store(edges, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).where("relation = 'binds'").count() == 1
    sinks.relation_csv(edges, str(tmp_path / "csv"))
    assert readers.relation_files(spark, str(tmp_path / "csv")).count() == 2
    for _ in range(2):
        sinks.append_metrics(spark.createDataFrame([(0.5,)], "mrr double"), str(tmp_path / "metrics"))
    assert spark.read.csv(str(tmp_path / "metrics"), header=True).count() == 2
    sinks.flat_csv(spark.createDataFrame([(1, [0.5, 1.0])], "i int, x array<double>"), str(tmp_path / "flat"))
    assert spark.read.csv(str(tmp_path / "flat"), header=True).first().x == "[0.5,1.0]"


def test_fasta(spark, tmp_path):
    path = put(tmp_path / "p.fasta", ">sp|P1|A x>y OS=Homo sapiens OX=9606 GN=AAA PE=1\nMKV\nLL\n>sp|P2|B OS=Mus musculus OX=1\n\nMM\n>sp|P3 GN=C\nM\n")
    got = [tuple(r) for r in readers.fasta(spark, path).collect()]
    assert got == [("sp|P1|A", "Homo sapiens", "AAA", "MKVLL"), ("sp|P2|B", "Mus musculus", None, "MM"), ("sp|P3", None, "C", "M")]


def test_matrix(spark, tmp_path):
    m = put(tmp_path / "m.txt", "0 1\n2.5 0\n0 3\n")
    got = readers.dense_matrix(spark, m, put(tmp_path / "r.txt", "a\nb\nc\n"), put(tmp_path / "c.txt", "x\ny\n"))
    assert sorted((r.row_name, r.col_name, r.value) for r in got.collect()) == [("a", "y", 1.0), ("b", "x", 2.5), ("c", "y", 3.0)]


def test_matrix_in_many_splits(spark, tmp_path):
    rows = [" ".join(str((i * 7 + j) % 5) for j in range(1 + i % 9)) + ("  " if i % 4 else "") if i % 11 else "" for i in range(700)]
    m, names = put(tmp_path / "big.txt", "\n".join(rows) + "\n\n"), put(tmp_path / "names.txt", "".join(f"n{i}\n" for i in range(700)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert spark.read.text(m).rdd.getNumPartitions() > 8
        got = readers.dense_matrix(spark, m, names)
        want = {(f"n{i}", j, float(x)) for i, r in enumerate(rows) for j, x in enumerate(r.split()) if x != "0"}
        found = [(r.row_name, r.col, r.value) for r in got.collect()]
        assert len(found) == len(want) and set(found) == want
    finally:
        for k, v in zip(("maxPartitionBytes", "openCostInBytes"), before):
            spark.conf.set(f"spark.sql.files.{k}", v)


def test_logs_and_folds(spark, tmp_path):
    put(tmp_path / "logs/a/1.log", "start\nindex 3\nremoved relation: binds\n")
    put(tmp_path / "logs/2.log", "index 4\n")
    put(tmp_path / "logs/3.log", "nothing\n")
    got = readers.log_relations(spark, str(tmp_path / "logs"), r"index (\d+)", r"relation: (\w+)")
    assert sorted((r.idx, list(r.relations)) for r in got.collect()) == [("3", ["binds"]), ("4", [])]
    for fold, uid in ((0, "u"), (1, "v"), (1, "w")):
        put(tmp_path / f"runs/FOLD_{fold}/{uid}/predictions.csv", "drug,score\n1,0.5\n")
    assert [tuple(r) for r in readers.fold_predictions(spark, str(tmp_path / "runs"), "drug long, score double", [0, 7]).collect()] == [(1, 0.5, 0, "u")]
    with pytest.warns(UserWarning, match="fold 1 has 2 runs"):
        both = readers.fold_predictions(spark, str(tmp_path / "runs"), "drug long, score double", [0, 1])
    assert [r.fold for r in both.collect()] == [0]


def test_slices_and_lookups(spark):
    df = spark.range(100)
    assert readers.slice_percent(df, ["id"], 0, 90).count() == 90 and readers.slice_percent(df, ["id"], 90, 100).count() == 10
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    found = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early")], "name string, pos int, smiles string")
    assert sorted((r.name, r.smiles or "") for r in readers.first_hit(names, found, "name", "pos").collect()) == [("a", "early"), ("b", "")]
    pages = spark.createDataFrame([(0, "From\tTo\na\tb\n"), (1, "From\tTo\nc\td")], "page int, body string")
    assert sorted(tuple(r) for r in readers.combine_pages(pages).collect()) == [("a", "b"), ("c", "d")]
    cells = spark.createDataFrame([("s", "g", 1.0), ("s", "h", 2.0), ("t", "g", 3.0)], "sig_id string, gene_id string, value double")
    assert readers.signature_cells(cells, spark.createDataFrame([("s",)], "sig_id string"), spark.createDataFrame([("g",)], "gene_id string")).count() == 1
