"""Readers: each gives a DataFrame with an explicit schema."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgloom.schema import EDGE

#: Column names of header-less association files with # comments (fixed values).
CHEMICAL_DISEASE = "ChemicalName string, ChemicalID string, CasRN string, DiseaseName string, DiseaseID string, DirectEvidence string, InferenceGeneSymbol string, InferenceScore double, OmimIDs string, PubMedIDs string"
GENE_DISEASE = "GeneSymbol string, GeneID string, DiseaseName string, DiseaseID string, DirectEvidence string, OmimIDs string, PubMedIDs string"
GENE_PATHWAY = "GeneSymbol string, GeneID string, PathwayName string, PathwayID string"


def relation_files(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Edges of one or many relation files, as one table."""
    return spark.read.schema(EDGE).csv(paths, header=True)


def headered_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def commented_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV without a header whose comment lines start with #."""
    return spark.read.schema(schema).option("comment", "#").csv(path)


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").csv(path, header=True)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """A plain list file: one trimmed name per row, blank lines left out."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''")


def fasta_columns(record) -> list:
    """id, organism, gene_name, sequence of a record without its leading '>'."""
    header = F.substring_index(record, "\n", 1)
    body = F.when(F.instr(record, "\n") > 0, F.substr(record, F.instr(record, "\n") + 1)).otherwise("")
    known = lambda p: F.nullif(F.regexp_extract(header, p, 1), F.lit(""))
    return [
        F.regexp_extract(header, r"^(\S+)", 1).alias("id"),
        known(r"OS=(.+?)\s+OX=").alias("organism"),
        known(r"GN=(\S+)").alias("gene_name"),
        F.regexp_replace(body, r"\s", "").alias("sequence"),
    ]


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """id, organism, gene_name, sequence; records begin with > at the start of a line, sequences may span lines, blank lines don't count."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^\s*>", "").alias("value")).where(F.regexp_replace("value", r"\s", "") != "")
    return rows.select(*fasta_columns(F.col("value")))


def numbered_lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The lines of a file, or of a folder's files in order of their paths, with their numbers, from 0; read in as many splits as any text file.

    Spark says where a line's split begins, and lines of a split come in order, so a number is the lines of earlier splits plus the place in its own.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.struct("_metadata.file_path", "_metadata.file_block_start").alias("__at"), F.monotonically_increasing_id().alias("__id"))
    splits = lines.groupBy("__at").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    splits = splits.withColumn("__before", F.sum("__n").over(Window.orderBy("__at")) - F.col("__n"))
    return lines.join(splits, "__at").select((F.col("__before") + F.col("__id") - F.col("__first")).cast("int").alias(name), "line")


def dense_matrix(spark: SparkSession, path: str, row_names: str | None = None, column_names: str | None = None) -> DataFrame:
    """row, col, value of the cells that aren't zero in a white-space separated matrix, with names where given."""
    cells = numbered_lines(spark, path, "row").where(F.trim("line") != "").select("row", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("col", "value"))
    cells = cells.withColumn("value", F.col("value").try_cast("double")).where("value <> 0")
    for names, at in ((row_names, "row"), (column_names, "col")):
        if names:
            cells = cells.join(numbered_lines(spark, names, at).select(at, F.trim("line").alias(f"{at}_name")), at)
    return cells


def log_relations(spark: SparkSession, path: str, index_pattern: str, relation_pattern: str) -> DataFrame:
    """idx, relations: what each log file below path says, by two patterns with a group each."""
    rows = spark.read.option("recursiveFileLookup", True).text(path).select(F.input_file_name().alias("file"), "value")
    found = rows.select("file", *[F.nullif(F.regexp_extract("value", p, 1), F.lit("")).alias(n) for n, p in (("idx", index_pattern), ("relation", relation_pattern))])
    files = found.groupBy("file").agg(F.max("idx").alias("idx"), F.collect_set("relation").alias("relations")).where("idx IS NOT NULL")
    return files.groupBy("idx").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("relations")))).alias("relations"))


def fold_predictions(spark: SparkSession, root: str, schema: str, folds: list[int]) -> DataFrame:
    """Predictions below root/FOLD_i/<uid>/predictions.csv with their fold and uid.

    A fold with none is left out; so is one with several runs, with a warning, as they can't be told apart.
    """
    rows = spark.read.schema(schema).csv(f"{root}/FOLD_*/*/predictions.csv", header=True)
    file = F.col("_metadata.file_path")
    rows = rows.select("*", F.regexp_extract(file, r"FOLD_(\d+)/", 1).cast("int").alias("fold"), F.regexp_extract(file, r"FOLD_\d+/([^/]+)/", 1).alias("uid"))
    rows = rows.where(F.col("fold").isin(folds))
    many = rows.groupBy("fold").agg(F.count_distinct("uid").alias("runs")).where("runs > 1").orderBy("fold").collect()
    for r in many:
        warnings.warn(f"fold {r.fold} has {r.runs} runs and is left out", stacklevel=2)
    return rows.where(~F.col("fold").isin([r.fold for r in many])) if many else rows


def metric_files(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """All metric CSV files that match, with the folder each lies in."""
    rows = spark.read.schema(schema).csv(pattern, header=True)
    return rows.select("*", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("run"))


def official_split(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark triples stored with their official split."""
    return spark.read.schema("split string, head_type string, head long, relation long, tail_type string, tail long").parquet(path)


def signature_cells(matrix: DataFrame, signatures: DataFrame, genes: DataFrame) -> DataFrame:
    """sig_id, gene_id, value of the chosen rows and columns of a matrix kept as long rows.

    Both choices are semi joins, so they reach the scan as runtime filters.
    """
    return matrix.join(signatures.select("sig_id"), "sig_id", "left_semi").join(genes.select("gene_id"), "gene_id", "left_semi")


def slice_percent(df: DataFrame, order: list[str], low: float, high: float) -> DataFrame:
    """The rows from low to high percent of the table in the order."""
    from kgloom.schema import position, with_constants

    n = df.agg(F.count("*").alias("__n"))
    out = with_constants(position(df, *order, name="__pos"), n)
    return out.where((F.col("__pos") >= F.floor(F.col("__n") * low / 100)) & (F.col("__pos") < F.floor(F.col("__n") * high / 100))).drop("__pos", "__n")


def combine_pages(pages: DataFrame) -> DataFrame:
    """Rows of paged TSV answers (page, body): headers of later pages are left out. Columns from, to."""
    rows = pages.select("page", F.posexplode(F.split("body", "\n")).alias("line_no", "line")).where("line_no > 0 AND line <> ''")
    parts = F.split("line", "\t")
    return rows.select(parts[0].alias("from"), parts[1].alias("to"))


def first_hit(names: DataFrame, found: DataFrame, key: str, order: str) -> DataFrame:
    """Left lookup of each name's first hit in an offline table."""
    w = Window.partitionBy(key).orderBy(order)
    return names.join(found.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n"), key, "left")
