import ast
import pathlib
import subprocess
import sys

import pytest

import __spark_entry__
from kgloom.plans import registry

ROOT = pathlib.Path(__file__).resolve().parent.parent
SMALL = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    row = __spark_entry__.entry(spark).first()
    assert row.positives > 0 and 0 < row.mrr <= 1


def test_sql_has_queries():
    assert set(registry.oracle_sql()) <= set(registry.queries()) and len(registry.queries()) > 60
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["edges_indexed", "error_rate_interp", "ece", "cosine_knn"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in pathlib.Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    df = registry.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(tuple(r) for r in df.select(*cols).collect()) == sorted(want)


def test_library_does_not_import_the_optional_part():
    for f in (ROOT / "kgloom").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            for node in ast.walk(ast.parse(f.read_text())):
                names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
                assert not any(n.startswith("kgloom.llm") for n in names), f


def test_entry_without_the_optional_part(tmp_path):
    for f in ROOT.rglob("*.py"):
        part = f.relative_to(ROOT)
        if "llm" not in part.parts and part.name != "corpus_pipeline.py":
            (tmp_path / part).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / part).write_text(f.read_text())
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    n, pipeline, _ = out.stdout.split()
    assert int(n) > 60 and pipeline == "False"


def test_entry_without_a_library_of_the_optional_part():
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    assert int(out.stdout.split()[0]) > 60 and out.stdout.split()[1] == "False" and "without the training-data queries" in out.stderr
