"""Similarity joins over vectors by blocked matrix products.

Vectors are dealt into blocks; each pair of blocks is one task group's matrix product, so no task
holds more than two blocks and no side is broadcast. The number of block pairs grows with the square of the
table, as all-pairs similarity must; thresholds and top-k are applied inside the product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgloom.functions.vectors import cosine, doubles, mean_squared_difference
from kgloom.operators.quantiles import quantiles
from kgloom.schema import position, with_constants
from kgloom.storage import materialize

#: A block has about an eighth of the rows, between these; wide vectors have fewer rows to a block. Each row goes to as many block pairs as there are blocks.
BLOCK_ROWS, MOST_ROWS, BLOCK_NUMBERS = 2000, 24_576, 1_572_864
#: Cosines that a task holds at a time.
GRID = 2_097_152


def _block_rows(vectors: DataFrame, vec_col: str) -> int:
    """Rows of a block of these vectors."""
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size(vec_col)).alias("width")).first()
    most = max(BLOCK_ROWS, min(MOST_ROWS, BLOCK_NUMBERS // max(1, size.width or 1)))
    return min(most, max(BLOCK_ROWS, -(-size.n // 8)))


def _slices(x: pd.DataFrame, y: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids of some rows of x, ids of y, and their cosines."""
    if len(x) and len(y):
        u, v = _unit(np.stack(x.v.to_numpy())), _unit(np.stack(y.v.to_numpy())).T
        p, q, n = x.id.to_numpy(), y.id.to_numpy(), max(1, GRID // len(y))
        for at in range(0, len(u), n):
            yield p[at : at + n], q, u[at : at + n] @ v


def _frame(parts: list[dict[str, np.ndarray]]) -> pd.DataFrame:
    """i, j, cos of all parts."""
    return pd.DataFrame({c: np.concatenate([x[c] for x in parts]) if parts else [] for c in ("i", "j", "cos")})


def _block_pairs(vectors: DataFrame, id_col: str, vec_col: str, triangular: bool, block_rows: int | None) -> DataFrame:
    """a, b, side, id, v: the rows of both blocks of every pair of blocks."""
    rows = vectors.select(F.col(id_col).alias("id"), doubles(vec_col).alias("v")).where("v IS NOT NULL")
    blocks = max(1, -(-vectors.count() // (block_rows or _block_rows(vectors, vec_col))))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    others = F.sequence(F.lit(0), F.lit(blocks - 1))
    left = rows.withColumn("other", F.explode(F.filter(others, lambda o: o >= F.col("own")) if triangular else others))
    right = rows.withColumn("other", F.explode(F.filter(others, lambda o: o <= F.col("own")) if triangular else others))
    return left.select(F.col("own").alias("a"), F.col("other").alias("b"), F.lit(0).alias("side"), "id", "v").unionByName(
        right.select(F.col("other").alias("a"), F.col("own").alias("b"), F.lit(1).alias("side"), "id", "v")
    )


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


def cosine_above(vectors: DataFrame, threshold: float, id_col: str = "id", vec_col: str = "embedding", block_rows: int | None = None) -> DataFrame:
    """i, j, cos of the pairs i < j whose cosine is over the threshold."""

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        own, parts = pdf.a.iloc[0] == pdf.b.iloc[0], []
        for ids, others, c in _slices(pdf[pdf.side == 0], pdf[pdf.side == 1]):
            i, j = np.nonzero(c > threshold)
            p, q = ids[i], others[j]
            keep = p < q if own else p != q
            parts.append({"i": np.minimum(p, q)[keep], "j": np.maximum(p, q)[keep], "cos": c[i, j][keep]})
        return _frame(parts)

    pairs = _block_pairs(vectors, id_col, vec_col, True, block_rows)
    return pairs.groupBy("a", "b").applyInPandas(product, "i long, j long, cos double")


def cosine_knn(vectors: DataFrame, k: int, id_col: str = "id", vec_col: str = "embedding", block_rows: int | None = None) -> DataFrame:
    """i, j, cos, rank: the k nearest others of each vector, ties by the smaller id.

    Each block product keeps k per row, all that tie with the k-th included, so the final ranking is exact.
    """

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for p, q, c in _slices(pdf[pdf.side == 0], pdf[pdf.side == 1]):
            c[p[:, None] == q[None, :]] = -np.inf
            least = np.partition(c, -min(k, c.shape[1]), axis=1)[:, -min(k, c.shape[1])]
            i, j = np.nonzero((c >= least[:, None] - 1e-12) & np.isfinite(c))
            parts.append({"i": p[i], "j": q[j], "cos": c[i, j]})
        return _frame(parts)

    found = _block_pairs(vectors, id_col, vec_col, False, block_rows).groupBy("a", "b").applyInPandas(product, "i long, j long, cos double")
    nearest = Window.partitionBy("i").orderBy(F.desc(F.round("cos", 12)), "j")
    return found.withColumn("rank", F.row_number().over(nearest).cast("long")).where(F.col("rank") <= k)


def pair_measures(pairs: DataFrame, vectors: DataFrame, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """pairs(i, j) with cos_sim and mse, by two equi joins."""
    side = lambda n: vectors.select(F.col(id_col).alias(n), doubles(vec_col).alias(f"__{n}"))
    rows = pairs.join(side("i"), "i").join(side("j"), "j")
    return rows.withColumns({"cos_sim": cosine(F.col("__i"), F.col("__j")), "mse": mean_squared_difference(F.col("__i"), F.col("__j"))}).drop("__i", "__j")


def above_quantile(pairs: DataFrame, value: str, q: float) -> DataFrame:
    """Rows strictly above the exact q-quantile (linear interpolation) of the value."""
    at = quantiles(pairs, value, [q]).agg(F.max("value").alias("__q"))
    return pairs.crossJoin(F.broadcast(at)).where(F.col(value) > F.col("__q")).drop("__q")


def cosine_above_quantile(vectors: DataFrame, q: float, id_col: str = "id", vec_col: str = "embedding", block_rows: int | None = None, bins: int = 1 << 16) -> DataFrame:
    """i, j, cos of all pairs i < j whose cosine is over the exact q-quantile (linear interpolation) of all pairs.

    A first product counts the cosines by `bins` even steps; the driver gets those counts alone. A second one gives the pairs
    from the step of the quantile on, which are written once; the step's own are put in order, and the quantile is found by their places. Blocks are sorted by id, so both agree.
    """
    place = lambda c: np.clip(((c + 1) / 2 * bins).astype(np.int64), 0, bins - 1)

    def cosines(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        own = pdf.a.iloc[0] == pdf.b.iloc[0]
        for p, r, c in _slices(*(pdf[pdf.side == k].sort_values("id") for k in (0, 1))):
            yield p, r, c, p[:, None] < r[None, :] if own else p[:, None] != r[None, :]

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(bins, np.int64)
        for _, _, c, keep in cosines(pdf):
            n += np.bincount(place(c[keep]), minlength=bins)
        seen = np.flatnonzero(n)
        return pd.DataFrame({"bin": seen, "n": n[seen]})

    pairs = _block_pairs(vectors, id_col, vec_col, True, block_rows).groupBy("a", "b")
    counts = pairs.applyInPandas(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").collect()
    at = q * (sum(r.n for r in counts) - 1)
    below, least = 0, 0
    for r in counts:
        if below + r.n > int(at):
            least = r.bin
            break
        below += r.n

    def high(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for p, r, c, keep in cosines(pdf):
            i, j = np.nonzero(keep & (c >= (2.0 * least / bins - 1) - 1e-9))
            top = c[i, j]
            sure = place(top) >= least
            i, j = p[i[sure]], r[j[sure]]
            parts.append({"i": np.minimum(i, j), "j": np.maximum(i, j), "cos": top[sure]})
        return _frame(parts)

    found = materialize(pairs.applyInPandas(high, "i long, j long, cos double"), "high")
    # only the quantile's own step is put in order: the pairs at its two places, the second of which may lie beyond the step
    step_ = (F.col("cos") + 1) / 2 * bins
    ranked = position(found.where(step_ < least + 1 + 1e-3), "cos", "i", "j")
    first, second = int(at) - below, int(at) - below + 1
    ends = ranked.where(F.col("pos").isin([first, second])).agg(F.min("cos").alias("__a"), F.max("cos").alias("__b"), F.count("*").alias("__n"))
    beyond = found.where(step_ >= least + 1 + 1e-3).agg(F.min("cos").alias("__c"))
    upper = F.when(F.col("__n") < 2, F.coalesce("__c", "__b")).otherwise(F.col("__b"))
    bound = with_constants(ends, beyond).select((F.col("__a") + (at - int(at)) * (upper - F.col("__a"))).alias("__q"))
    return with_constants(found, bound).where(F.col("cos") > F.col("__q")).select("i", "j", "cos")


def block_map(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """x'x of each batch of vectors, as i, j, s."""
    total = None
    for pdf in batches:
        if len(pdf):
            x = np.stack(pdf.v.to_numpy()).astype(float)
            total = x.T @ x if total is None else total + x.T @ x
    if total is not None:
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "s": total.ravel()})


def gram(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """i, j, s: the d x d Gram matrix, one partial matrix per partition and then a sum."""
    rows = vectors.select(doubles(vec_col).alias("v")).where("v IS NOT NULL")
    return rows.mapInPandas(block_map, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
