"""Queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm import bpe, collocations, decontamination, exact_dedup, html_text, language_id, line_dedup, masked_lm, mixing, simhash, token_files, warc, whitening
from kgloom.llm.common import drop_path, new_path, shared_dir, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    coded = bpe.with_codes(docs, TOKENIZER)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def as_stored(record_id: str, data: bytes) -> bytes | None:
    """What the storage of op2's second replica makes of a record, by its id's crc32 modulo 291: a flipped bit in the middle, nothing, or a broken beginning."""
    kind = zlib.crc32(record_id.encode()) % 291
    if kind == 6:
        return None
    if kind not in (5, 7):
        return data
    at = len(data) // 2 if kind == 5 else 0
    return data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC files in two replicas, the second with damage: where each record lies and its status."""
    pages, paths = table(spark, sf_dir, "pages"), [new_path(spark, f"warc-{k}") for k in "ab"]
    warc.write(pages, paths[0])
    warc.write(pages, paths[1], stored=as_stored)
    found = warc.fixity(spark, *paths)
    for path in paths:  # their trees are written
        drop_path(spark, path)
    return found.select(F.regexp_extract("record_id", r"page:(-?\d+)", 1).cast("long").alias("page_id"), "shard", "offset", "length", F.lower(F.hex("hash")).alias("sha256"), "status")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op5_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.score(table(spark, sf_dir, "documents"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write(table(spark, sf_dir, "documents"), out, TOKENIZER)
    return token_files.read_checksums(spark, out)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "copies")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_codec": op1_bpe_codec,
    "op2_warc_fixity": op2_warc_fixity,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_language_id": op4_language_id,
    "op5_masked_lm": op5_masked_lm,
    "op6_main_text": op6_main_text,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_token_files": op10_token_files,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_source_mixing": op12_source_mixing,
    "op13_phrase_collocations": op13_phrase_collocations,
}

_SQUEEZED = "regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')"

ORACLE_SQL: dict[str, str] = {
    "op8_line_dedup": """
        WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        p AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM l),
        w AS (SELECT doc_id, pos, line || chr(10) || lead(line, 1) OVER d || chr(10) || lead(line, 2) OVER d AS win FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
        r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS nth FROM w WHERE win IS NOT NULL AND trim(replace(win, chr(10), '')) <> ''),
        m AS (SELECT DISTINCT doc_id, pos + k AS pos FROM r, (VALUES (0), (1), (2)) AS s(k) WHERE nth > 1)
        SELECT p.doc_id, count(*) AS n_lines, count(m.pos) AS n_removed,
               sha256(coalesce(string_agg(p.line, chr(10) ORDER BY p.pos) FILTER (WHERE m.pos IS NULL), '')) AS text_sha256
        FROM p LEFT JOIN m ON p.doc_id = m.doc_id AND p.pos = m.pos GROUP BY p.doc_id
    """,
    "op9_exact_dedup": f"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256({_SQUEEZED}) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, count(*) AS group_size, arg_min(doc_id, row(-n, doc_id)) AS keep_id FROM t GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
    """,
    "op13_phrase_collocations": r"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
        w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM p),
        g AS (SELECT lang, k, unnest([array_to_string(ws[i : i + k - 1], ' ') FOR i IN range(1, len(ws) - k + 2)]) AS phrase FROM w, (VALUES (1), (2), (3)) AS s(k)),
        f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase),
        n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
        o AS MATERIALIZED (SELECT lang, phrase, f FROM f WHERE f >= 10),
        c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 10),
        h AS MATERIALIZED (SELECT lang, k, phrase, a, j, array_to_string(ws[1 : j], ' ') AS x, array_to_string(ws[j + 1 : k], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
        cuts AS (SELECT h.lang, h.k, h.phrase, h.a, h.j, x.f AS l, y.f AS r, (1000000 * h.a::HUGEINT * h.a::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS score
            FROM h JOIN o x ON x.lang = h.lang AND x.phrase = h.x JOIN o y ON y.lang = h.lang AND y.phrase = h.y),
        m AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
        e AS (SELECT lang, phrase, max(a) AS f FROM (SELECT lang, unnest([array_to_string(ws[1 : 2], ' '), array_to_string(ws[2 : 3], ' ')]) AS phrase, a FROM c WHERE k = 3) GROUP BY lang, phrase)
        SELECT m.lang, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, m.a DESC, encode(m.phrase)) AS rank, m.phrase, m.a, m.l, m.r, n.n, CAST(score AS BIGINT) AS score
        FROM m JOIN n ON n.lang = m.lang LEFT JOIN e ON e.lang = m.lang AND e.phrase = m.phrase WHERE e.f IS NULL OR m.k > 2 OR 100 * e.f < 50 * m.a QUALIFY rank <= 2000
    """,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
