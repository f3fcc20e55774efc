"""Line deduplication by overlapping three-line windows. DataFrame operations only.

Each line is hashed twice, once, and every run of three consecutive lines of a document is a window, known by two hashes of
those. A window
that occurs more than once anywhere is repeated; its first occurrence is the one with the smallest
document id, then the smallest line number. All later occurrences mark their three lines; overlapping
marks merge, and what lies between them is cut out of the list of lines and joined, in time that grows with its length. A removed line always has an equal line at the first
occurrence, or further on at that one's own first occurrence, so no line is lost altogether.

Occurrences are counted before they are shuffled, and joined back to the repeated windows by an
equi join that adaptive execution may split, so a window with very many occurrences is no hot group.

Defined results: null text is empty; lines are what stands between line feeds; documents of fewer
than three lines have no window and stay whole; windows of three blank lines don't count; null
ids come first, each a row of its own; of rows that repeat an id, those of other texts are documents of their own,
and rows equal in id and text are one document with one set of marks; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import materialize, split_join, with_marks

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def windows(docs: DataFrame, marks: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, x, y (the row's marks), line, h1, h2: every three-line window with a line that isn't blank."""
    rows = docs.select(F.col(id_col).alias("id"), *[F.col(m).alias(n) for m, n in zip(marks, "xy")], _lines(F.col(text_col)).alias("lines")).where(F.size("lines") >= WINDOW)
    each = F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("p"), F.hash(x).alias("q"), (F.length(F.trim(x)) > 0).alias("full")))
    rows = rows.select("id", "x", "y", each.alias("l"))
    # three lists, each a line further on, side by side
    beside = F.arrays_zip(*[F.slice("l", k + 1, F.size("l") - (WINDOW - 1)).alias(n) for k, n in enumerate("abc")])
    rows = rows.select("id", "x", "y", F.posexplode(beside).alias("line", "w"))
    return rows.where("w.a.full OR w.b.full OR w.c.full").select("id", "x", "y", "line", F.xxhash64("w.a.p", "w.b.p", "w.c.p").alias("h1"), F.hash("w.c.q", "w.a.q", "w.b.q").alias("h2"))


def marked_lines(docs: DataFrame, marks: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, x, y, starts: where later occurrences begin in each document, sorted."""
    found = materialize(windows(docs, marks, id_col, text_col), "windows")
    place = F.struct("id", "x", "y", "line")
    first = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    later = split_join(found, first, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("id", "x", "y").agg(F.array_sort(F.collect_set("line")).alias("starts"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text without the marked lines, n_lines, n_removed: one row per document."""
    docs, marks = with_marks(docs, id_col, text_col)
    marked = marked_lines(docs, marks, id_col, text_col).select(F.col("id").alias("_id"), "x", "y", "starts")
    rows = docs.select(F.col(id_col).alias("doc_id"), *[F.col(m).alias(f"_{n}") for m, n in zip(marks, "xy")], _lines(F.col(text_col)).alias("lines"))
    rows = rows.join(marked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_x") == F.col("x")) & (F.col("_y") == F.col("y")), "left")
    # what is kept lies between the end of one marked window and the start of the next one; marks that overlap leave nothing there
    ends = F.concat(F.array(F.lit(0)), F.transform("starts", lambda i: i + WINDOW))
    gaps = F.arrays_zip(ends.alias("low"), F.concat("starts", F.array(F.size("lines"))).alias("high"))
    rows = rows.withColumn("gaps", F.filter(gaps, lambda g: g["low"] < g["high"]))
    kept = F.flatten(F.transform("gaps", lambda g: F.slice("lines", g["low"] + 1, g["high"] - g["low"])))
    n_kept = F.aggregate("gaps", F.lit(0), lambda n, g: n + g["high"] - g["low"])
    return rows.select(
        "doc_id",
        F.array_join(F.when(F.col("starts").isNull(), F.col("lines")).otherwise(kept), "\n").alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("starts").isNull(), F.lit(0)).otherwise(F.size("lines") - n_kept).cast("long").alias("n_removed"),
    )
