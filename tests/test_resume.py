import pathlib

import pytest
from pyspark.sql import functions as F

from kgloom.plans import resume


def test_a_stopped_run_goes_on_where_it_stopped(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(10).write.parquet(source)
    broken = {"on": True}

    def count(df, by):
        if broken["on"]:
            raise RuntimeError("stopped")
        return df.groupBy((F.col("id") % by).alias("k")).count()

    double = resume.Step("double", lambda df: df.union(df), [source])
    counted = resume.Step("count", count, [double], {"by": 3})
    last = resume.Step("last", lambda a, b: a.join(b.select((F.col("id") % 3).alias("k")).distinct(), "k"), [counted, double])
    ran = []
    with pytest.raises(RuntimeError):
        resume.result(spark, last, root, ran)
    assert ran == ["double"]
    broken["on"] = False
    assert sorted(map(tuple, resume.result(spark, last, root, ran).collect())) == [(0, 8), (1, 6), (2, 6)]
    assert ran == ["double", "count", "last"]
    resume.result(spark, last, root, ran)
    assert ran == ["double", "count", "last"]

    other = resume.Step("count", count, [double], {"by": 2})  # other parameters: only this step
    assert resume.result(spark, other, root, ran).count() == 2 and ran[3:] == ["count"]

    next(pathlib.Path(root).glob("last-*/_SUCCESS")).unlink()  # as if it had been interrupted
    resume.result(spark, last, root, ran)
    assert ran[4:] == ["last"]

    spark.range(4).write.mode("overwrite").parquet(source)  # other input: all of them
    assert sum(r["count"] for r in resume.result(spark, last, root, ran).collect()) == 8 and ran[5:] == ["double", "count", "last"]
