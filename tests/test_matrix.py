import pathlib

import numpy as np
import pytest

from kgloom.sources import matrix


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    rows = [(f"r{i}", f"c{j}", float(np.float32(rng.normal()))) for i in range(37) for j in range(23) if rng.random() < 0.4]
    path = str(tmp_path_factory.mktemp("m") / "matrix")
    odd = [(None, "c1", 1.0), ("r1", None, 1.0), ("r1", "c1", None), rows[0]]
    matrix.write_matrix(spark.createDataFrame(rows + odd, "row string, column string, value double").repartition(3), path, block_rows=8, block_columns=5)
    return path, {(r, c): v for r, c, v in rows}


def ids(spark, names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_whole_and_chosen_parts(spark, stored):
    path, cells = stored
    read = lambda *a, **k: {(r.row, r.column): r.value for r in matrix.read_matrix(spark, path, *a, **k).collect()}
    assert read() == cells
    rows, columns = ["r9", "r3", "r30", "none", "r3"], ["c22", "c0"]
    want = {k: v for k, v in cells.items() if k[0] in rows and k[1] in columns}
    assert read(ids(spark, rows), ids(spark, columns)) == want
    assert read(ids(spark, rows)) == {k: v for k, v in cells.items() if k[0] in rows}
    assert read(ids(spark, ["none"])) == {}
    full = read(ids(spark, ["r9", "r3"]), ids(spark, columns), keep_zeros=True)
    assert full == {(r, c): cells.get((r, c), 0.0) for r in ("r9", "r3") for c in columns}


def test_other_blocks_are_not_read(spark, stored):
    path, cells = stored
    order = sorted({r for r, _ in cells})
    frame = matrix.read_matrix(spark, path, ids(spark, [order[0]]), ids(spark, ["c0"]))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [row_block" in plan and "PushedFilters: [In(column_block" in plan or "PushedFilters: [IsNotNull(column_block), EqualTo(column_block,0)]" in plan
    for f in pathlib.Path(path).glob("blocks/row_block=[1-9]*/*.parquet"):
        f.write_bytes(b"not a table")  # reading it would fail
    assert {(r.row, r.column): r.value for r in frame.collect()} == {k: v for k, v in cells.items() if k == (order[0], "c0")}


def test_empty_matrix(spark, tmp_path):
    matrix.write_matrix(spark.createDataFrame([], "row string, column string, value double"), str(tmp_path / "m"))
    assert matrix.read_matrix(spark, str(tmp_path / "m")).count() == 0


def test_blocks_with_few_cells_take_little_room(spark, tmp_path):
    rows = [(f"r{i:03}", f"c{i:03}", float(i + 1)) for i in range(200)] + [(f"r{i:03}", f"c{j:03}", i + j + 0.5) for i in range(8) for j in range(50)] + [("r150", "c150", 7.0)]
    cells = {}
    for r, c, v in rows:
        cells[r, c] = max(v, cells.get((r, c), v))
    path = str(tmp_path / "m")
    matrix.write_matrix(spark.createDataFrame(rows, "row string, column string, value double").repartition(3), path, block_rows=8, block_columns=50)
    assert {(r.row, r.column): r.value for r in matrix.read_matrix(spark, path).collect()} == cells
    stored = spark.read.parquet(f"{path}/blocks").selectExpr("row_block", "column_block", "coalesce(octet_length(data), 0) + 8 * coalesce(array_size(cells), 0) AS room").collect()
    held = lambda b: sum(1 for r, c in cells if int(r[1:]) // 8 == b.row_block and int(c[1:]) // 50 == b.column_block)
    assert all(b.room <= 8 * held(b) for b in stored)
    some = matrix.read_matrix(spark, path, ids(spark, ["r003", "r150"]), ids(spark, ["c150", "c007"]), keep_zeros=True)
    assert {(r.row, r.column): r.value for r in some.collect()} == {("r003", "c007"): 10.5, ("r150", "c150"): 151.0}
