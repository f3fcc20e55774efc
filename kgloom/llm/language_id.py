"""Language identification by compression.

Each language has a dictionary of raw content: snippets of its training documents. A text is cut
into blocks, every block is compressed with each language's dictionary (zstandard, raw-content
dictionary), and the language with the smallest total wins. Cutting into blocks keeps the
dictionary, not the text's own past, in charge of long texts; all blocks count, so whole texts
are read. The margin is the share by which the best total lies below the second best; a text
whose margin is narrow is rejected.

The dictionaries are fitted on a bounded sample: of each language the `sample_docs` training
documents with the smallest hash of their id, `snippet` bytes of each. The bound is
languages * sample_docs * snippet bytes. Classification covers every row.

Defined results: text that is null, empty or has no letter is `und` with score 0 and is
rejected; equal totals go to the language with most training rows, then the alphabetically first, with score 0; with no training
rows every text is `und`; with one language it always wins with score 1; null languages are
never learned; rows without an id are learnt from and predicted like any other; rows that repeat an id count as they are;
repeated rows get equal results; other columns of the input, whatever their names, don't matter.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_DOCS = 240
SNIPPET = 480
LEVEL = 9
BLOCK = 2000
#: Margins below this are too narrow to call.
NARROW = 0.001
_LETTER = regex.compile(r"\p{L}")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the document is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """id, lang, text of the rows that may be learnt from."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), held_out(id_col).alias("held_out"))
    return rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.col("held_out")).drop("held_out")


def training_sample(rows: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """lang, rank, text of training_rows(): per language those with the smallest id hash, ties by id and text; at most sample_docs of each.

    The top rows are found on ids alone; the window's group limit keeps at most sample_docs rows
    of a language in each partition before they are shuffled. Rows that share a chosen id are ranked once more with their texts.
    """
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    picked = rows.select("id", "lang").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample_docs)
    picked = picked.groupBy(F.col("lang").alias("_lang"), F.col("id").alias("_id")).agg(F.min("rank").alias("rank"))
    cut = rows.select("id", "lang", F.substring("text", 1, 4 * SNIPPET).alias("text"))
    found = cut.join(F.broadcast(picked), F.col("lang").eqNullSafe(F.col("_lang")) & F.col("id").eqNullSafe(F.col("_id"))).select("lang", "rank", "text")
    again = Window.partitionBy("lang").orderBy("rank", "text")
    return found.withColumn("again", F.row_number().over(again)).where(F.col("again") <= sample_docs).select("lang", F.col("again").alias("rank"), "text")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, snippet: int = SNIPPET) -> dict[str, bytes]:
    """The raw-content dictionary of each language, languages with more training rows first.

    Only the bounded sample and a row count per language reach the driver.
    """
    train = training_rows(docs, id_col, text_col, lang_col)
    out: dict[str, list[bytes]] = {}
    for r in sorted(training_sample(train, sample_docs).collect(), key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(prepared(r["text"]).encode()[:snippet])
    count = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    return {lang: b"\n".join(reversed(out[lang])) for lang in sorted(out, key=lambda x: (-count[x], x))}


def prepared(text: str) -> str:
    return text.lower()


class Classifier:
    """One compressor per language; made once in each task."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL, block: int = BLOCK):
        self.langs, self.block, self.squeeze = list(dictionaries), block, []
        for lang in self.langs:
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            self.squeeze.append(zstandard.ZstdCompressor(dict_data=content, level=level, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def classify(self, text: str | None) -> tuple[str, float]:
        """The language and the margin."""
        if not text or not self.langs or not _LETTER.search(text):
            return "und", 0.0
        data = prepared(text).encode()
        blocks = [data[i : i + self.block] for i in range(0, len(data), self.block)]
        totals = [sum(len(squeeze(b)) for b in blocks) for squeeze in self.squeeze]
        if len(totals) == 1:
            return self.langs[0], 1.0
        best, second = sorted(totals)[:2]
        return self.langs[totals.index(best)], 1 - best / second


def classifier(dictionaries: dict[str, bytes]) -> Callable[[Column], Column]:
    """text -> struct<lang string, score double>, in Arrow batches. The dictionaries are bounded by fit()."""
    made: list[Classifier] = []

    def classify(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Classifier(dictionaries))
        found = [made[0].classify(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["lang", "score"])

    return F.arrow_udf(classify, "struct<lang:string,score:double>")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: one row per document."""
    label = classifier(fit(docs, id_col, text_col, lang_col))
    return docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), label(F.col(text_col)).alias("x")).select(
        "doc_id", "held_out", F.col("x.lang").alias("lang_pred"), F.col("x.score").alias("score"), (F.col("x.score") < NARROW).alias("rejected")
    )


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that the classifier doesn't reject; all columns as they were."""
    label = classifier(fit(docs, id_col, text_col, lang_col))
    return docs.where(label(F.col(text_col))["score"] >= NARROW)
