"""Exact deduplication by a tree-merge of sorted digest runs. DataFrame operations only.

Every input partition is a leaf. It sorts its rows by digest and keeps one entry per digest (the
map side of a sort aggregate): a sorted run. In each round the runs of `fan_in` neighbouring
groups meet and are merged multiway, again keeping one entry per digest, until all leaves belong
to one group. The groups of a round are hash-partitioned by digest, so no task holds a whole run,
and a text with very many copies arrives as one entry per group, never as its rows.

Defined results: null text counts as empty; texts are equal if they are identical without
[\\x20\\x09-\\x0D]; the row with most code points in its original text stays, then the smallest
id (null ids sort first); in the table of decisions, rows that repeat an id and a text share one; the stage decides by row: only
the best row of a text stays, rows of one id with other texts and rows without an id are rows of their own, and of rows equal
in id and text one stays, whatever their other columns (that of the least JSON text); an empty table gives an empty result; other columns of the input, whatever their names, don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import ASCII_SPACE, materialize, one_of_repeated, with_marks, without_rows


def squeezed(text: Column) -> Column:
    """The text without ASCII white space; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for c in ASCII_SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def digest_rows(docs: DataFrame, id_col: str, text_col: str, leaves: int, marks: list[str] = ()) -> DataFrame:
    """id, digest, two independent verifiers of it, original length and leaf of every row; x and y of its marks, if there are any."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.length(text).cast("long").alias("n"), squeezed(F.col(text_col)).alias("t"), *[F.col(m).alias(n) for m, n in zip(marks, "xy")])
    return rows.select(
        "id",
        "n",
        F.unhex(F.sha2("t", 256)).alias("digest"),
        F.length("t").alias("size"),
        F.xxhash64("t").alias("check"),
        F.pmod(F.spark_partition_id(), F.lit(leaves)).alias("run"),
        *"xy"[: len(marks)],
    )


def merge_round(runs: DataFrame, fan_in: int) -> DataFrame:
    """One round: merge the runs of each `fan_in` neighbours. The best entry is the smallest (-n, id).

    Entries count as the same text only if digest, length and second hash agree.
    """
    return (
        runs.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
        .groupBy("run", "digest", "size", "check")
        .agg(F.min("best").alias("best"), F.sum("copies").alias("copies"))
    )


def dedup_groups(rows: DataFrame, leaves: int = 512, fan_in: int = 8) -> DataFrame:
    """digest, size, check, best (struct of -n and id, then the marks), copies: one row per distinct text."""
    marks = [c for c in "xy" if c in rows.columns]
    runs = rows.select("run", "digest", "size", "check", F.struct((-F.col("n")).alias("neg_n"), F.col("id"), *marks).alias("best"), F.lit(1).cast("long").alias("copies"))
    runs, span = merge_round(runs, fan_in), fan_in
    while span < leaves:
        runs, span = merge_round(runs, fan_in), span * fan_in
    return runs.drop("run")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", leaves: int = 512, fan_in: int = 8) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row, dropped ones too.

    Only texts with copies are joined back; a text without copies keeps itself. The join is a
    plain equi join under adaptive execution, which splits the partition of a text with very many
    copies.
    """
    rows = materialize(digest_rows(docs, id_col, text_col, leaves), "digests")
    groups = (
        dedup_groups(rows, leaves, fan_in)
        .where("copies > 1")
        .select("digest", "size", "check", F.col("best.id").alias("best_id"), "copies")
    )
    return rows.join(groups, ["digest", "size", "check"], "left").select(
        F.col("id").alias("doc_id"),
        F.when(F.col("copies").isNull(), F.col("id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("copies", F.lit(1).cast("long")).alias("group_size"),
        (F.col("copies").isNull() | F.col("id").eqNullSafe(F.col("best_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without later copies; all columns as they were."""
    docs, marks = with_marks(docs, id_col, text_col)
    rows = materialize(digest_rows(docs, id_col, text_col, 512, marks), "digests")
    groups = dedup_groups(rows).where("copies > 1").select("digest", "size", "check", "best")
    best = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("x") == F.col("best.x")) & (F.col("y") == F.col("best.y"))
    members = materialize(rows.join(groups, ["digest", "size", "check"]).select("id", "x", "y", best.alias("kept")), "copies")
    again = members.where("kept").groupBy("id", "x", "y").count().where("count > 1")
    return without_rows(one_of_repeated(docs, marks, again, id_col), marks, members.where("NOT kept"), id_col)
