"""Steps whose written results are used again, as long as what they were made from is the same.

A step's fingerprint covers its name, its parameters, the files it reads (path, length, time of change) and the fingerprints of
steps it reads. Its result is a Parquet table in a folder of that fingerprint; Spark writes `_SUCCESS` there once all tasks have committed, so a folder without
it is an interrupted run and is written anew. A change upstream changes all fingerprints after it; nothing is overwritten in place.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Step:
    """make(inputs..., **params) gives the result; inputs are paths of Parquet tables or other steps."""

    name: str
    make: Callable[..., DataFrame]
    inputs: Sequence[str | Step] = ()
    params: dict = field(default_factory=dict)


def _files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Path, length and time of change of the files under a path, in order."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found, out = fs.listFiles(at, True), []
    while found.hasNext():
        f = found.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def fingerprint(spark: SparkSession, step: Step) -> str:
    parts = [fingerprint(spark, i) if isinstance(i, Step) else _files(spark, i) for i in step.inputs]
    text = json.dumps([step.name, step.params, parts], sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:32]


def _done(spark: SparkSession, folder: str) -> bool:
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def result(spark: SparkSession, step: Step, root: str, ran: list[str] | None = None) -> DataFrame:
    """The step's result, read if it is complete, else made and written; steps before it only if they are needed. `ran` gets the names of those that ran, in order."""
    folder = f"{root.rstrip('/')}/{step.name}-{fingerprint(spark, step)}"
    if not _done(spark, folder):
        made = step.make(*[result(spark, i, root, ran) if isinstance(i, Step) else spark.read.parquet(i) for i in step.inputs], **step.params)
        made.write.mode("overwrite").parquet(folder)
        if ran is not None:
            ran.append(step.name)
    return spark.read.parquet(folder)
