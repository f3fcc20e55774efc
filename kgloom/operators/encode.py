"""Encoding of sequences in batches of like length.

Long sequences are cut into overlapping chunks; a task sorts its chunks by length, WINDOW tokens at a time, and packs neighbours of nearly
the same length into batches of at most BUDGET cells, padding included, so no chunk is shuffled; an encoder turns each batch into vectors; a sequence's chunks are pooled
by the tokens that each one adds. The result doesn't depend on how chunks were packed, as long as the encoder heeds its mask.

Defined results: null and blank texts count as one X; rows that repeat an id are pooled as one sequence; numbers that aren't finite are kept and
counted in the report.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.storage import materialize

MAX_TOKENS, OVERLAP, BUDGET = 512, 64, 1 << 15
#: Tokens that a task sorts at a time, and those that it cuts from texts before it passes them on.
WINDOW, SLICE = 1 << 22, 1 << 19

Tokenizer = Callable[[str], np.ndarray]
#: (tokens, mask), both rows by places, to one vector for each row.
Encoder = Callable[[np.ndarray, np.ndarray], np.ndarray]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)


def cut(texts: pa.Array, tokenizer: Tokenizer, max_tokens: int, overlap: int, limit: int) -> Iterator[tuple[list[int], list[int], list[int], list[np.ndarray]]]:
    """Text, number, weight and tokens of each chunk, in slices that end with the text with which they have `limit` tokens."""
    at, number, weight, tokens, held = [], [], [], [], 0
    for k in range(len(texts)):
        t = tokenizer(texts[k].as_py())
        for c, begin in enumerate(range(0, max(1, len(t) - overlap), max_tokens - overlap)):
            part = t[begin : begin + max_tokens]
            at.append(k)
            number.append(c)
            weight.append(len(part) - (overlap if c else 0))
            tokens.append(part)
            held += len(part)
        if held >= limit:
            yield at, number, weight, tokens
            at, number, weight, tokens, held = [], [], [], [], 0
    if at:
        yield at, number, weight, tokens


def chunks(df: DataFrame, id_col: str, text_col: str, tokenizer: Tokenizer = code_points, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """id, chunk, weight (the tokens that it adds), tokens: every max_tokens tokens, `overlap` of them shared with the chunk before."""
    if not 0 <= overlap < max_tokens:
        raise ValueError("the overlap has to be shorter than a chunk")
    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("id"), F.trim(F.coalesce(F.col(text_col), F.lit(""))).alias("text")).withColumn("text", F.when(F.col("text") == "", "X").otherwise(F.col("text")))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, number, weight, tokens in cut(b.column("text"), tokenizer, max_tokens, overlap, SLICE):
                ends = np.append(0, np.cumsum([len(t) for t in tokens]))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(tokens), pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), pa.array(weight, pa.int32()), lists], names=["id", "chunk", "weight", "tokens"])

    return rows.mapInArrow(each, f"id {kind}, chunk int, weight int, tokens array<int>")


def packed(sizes: np.ndarray, budget: int) -> list[tuple[int, int]]:
    """Neighbouring rows (begin, end) of batches whose longest row times rows is at most the budget; a longer row is a batch of its own."""
    out, begin, longest = [], 0, 0
    for k, n in enumerate(sizes.tolist()):
        if k > begin and max(longest, n) * (k - begin + 1) > budget:
            out.append((begin, k))
            begin, longest = k, 0
        longest = max(longest, n)
    return out + ([(begin, len(sizes))] if len(sizes) > begin else [])


def encoded_chunks(parts: DataFrame, encoder: Encoder, budget: int = BUDGET, by_length: bool = True) -> DataFrame:
    """id, chunk, weight, vector, slots, used: each chunk's vector, and in the first row of each batch its cells and those that held a token."""
    kind = dict(parts.dtypes)["id"]
    rows = parts.withColumn("n", F.size("tokens"))

    def sorted_by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window, held = [], 0
        for b in batches:
            window.append(b)
            held += int(b.column("n").to_numpy().sum())
            if held >= WINDOW:
                yield from alike(window)
                window, held = [], 0
        if window:
            yield from alike(window)

    def alike(window: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sorted rows in pieces whose lengths differ by an eighth at most."""
        table = pa.Table.from_batches(window).sort_by("n").combine_chunks()
        kinds = np.floor(np.log(np.maximum(table["n"].to_numpy(), 1)) / np.log(1.125))
        ends = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
        for begin, end in zip(ends, ends[1:]):
            yield from table.slice(begin, end - begin).to_batches()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sorted_by_length(batches) if by_length else batches:
            tokens, sizes = b.column("tokens"), b.column("n").to_numpy()
            flat, starts = np.asarray(tokens.flatten()), np.concatenate([[0], np.cumsum(sizes)])
            for begin, end in packed(sizes, budget):
                width = max(1, int(sizes[begin:end].max()))
                mask = np.arange(width)[None, :] < sizes[begin:end, None]
                padded = np.zeros((end - begin, width), np.int32)
                padded[mask] = flat[starts[begin] : starts[end]]
                vectors = np.ascontiguousarray(encoder(padded, mask), dtype=np.float64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1) * vectors.shape[1], pa.int32()), pa.array(vectors.ravel()))
                own = lambda n: pa.array([n] + [0] * (end - begin - 1), pa.int64())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(begin, end - begin) for c in ("id", "chunk", "weight")), lists, own(mask.size), own(int(mask.sum()))], names=["id", "chunk", "weight", "vector", "slots", "used"])

    return rows.select("id", "chunk", "weight", "tokens", "n").mapInArrow(each, f"id {kind}, chunk int, weight int, vector array<double>, slots long, used long")


def encode(df: DataFrame, id_col: str, text_col: str, encoder: Encoder, dim: int, tokenizer: Tokenizer = code_points, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP, budget: int = BUDGET, by_length: bool = True) -> tuple[DataFrame, DataFrame]:
    """id, embedding of each id; and one row: chunks, cells of all batches, cells with a token, share of padding, vectors with a number that isn't finite."""
    done = materialize(encoded_chunks(chunks(df, id_col, text_col, tokenizer, max_tokens, overlap), encoder, budget, by_length), "encoded")
    pooled = F.array(*[F.sum(F.col("vector")[k] * F.col("weight")) / F.sum("weight") for k in range(dim)])
    finite = F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    report = done.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("slots"), F.lit(0)).alias("slots"), F.coalesce(F.sum("used"), F.lit(0)).alias("used"), F.count(F.when(~finite, 1)).alias("not_finite"))
    report = report.withColumn("padding", F.when(F.col("slots") > 0, 1 - F.col("used") / F.col("slots")).otherwise(0.0))
    return done.groupBy("id").agg(pooled.alias("embedding")), report


def wave_encoder(dim: int) -> Encoder:
    """A stand-in for a pretrained encoder: number k of a vector is the mean over the tokens of sin(token (k + 1) / 7)."""

    def run(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
        n, most = np.maximum(mask.sum(axis=1), 1), int(tokens.max(initial=0))
        few = most < tokens.size and tokens.min(initial=0) >= 0  # then each token's sine is taken once
        waves = lambda rate: np.sin(np.arange(most + 1) * rate)[tokens] if few else np.sin(tokens * rate)
        return np.stack([(waves((k + 1) / 7) * mask).sum(axis=1) / n for k in range(dim)], axis=1)

    return run
