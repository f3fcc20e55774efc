"""Similarity joins that don't compare all pairs: exact by pivots, approximate by random hyperplanes.

Both deal vectors to places and compare within a place: one side of a place are the vectors at home there, the other those that
visit it. Places are counted first; a large one is cut into blocks of homes and blocks of visitors, so a task holds HOMES + VISITORS
vectors at most, whatever the data. Every pair that shares a place is verified with its exact cosine.

Equal vectors are one representative, the least id: `members` says who belongs to it, so copies are never compared with each other.
Pairs are those of representatives. Null vectors, empty ones and those of length zero, which have no direction, are in no pair and no class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.functions.vectors import doubles, norm
from kgloom.schema import small
from kgloom.storage import materialize

#: Rows of a block on either side, and the rows that pivots are picked from.
HOMES, VISITORS, SAMPLE = 2000, 20_000, 4096
#: Vectors that are copied to their places at a time; one may visit the rings of all pivots.
DEALT = 100
PLACE = "cell int, ring long, side int, same int"


@dataclass
class Join:
    """pairs(i, j, cos) of representatives, i < j; members(rep, id); places(cell, ring, homes, visits), whose products are the comparisons made."""

    pairs: DataFrame
    members: DataFrame
    places: DataFrame

    def compared(self) -> DataFrame:
        """One row: n vectors, all pairs of them, and the comparisons made (a pair counts once for each place it shares, within a ring twice)."""
        made = self.places.agg(F.coalesce(F.sum(F.col("homes").cast("decimal(38,0)") * F.col("visits")), F.lit(0)).cast("long").alias("compared"))
        n = self.members.agg(F.count_distinct("rep").alias("n"))
        return n.crossJoin(made).select("n", F.expr("n * (n - 1) div 2").alias("all_pairs"), "compared")


def units(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """Representatives (id, v of length one) and members (rep, id)."""
    known = vectors.select(F.col(id_col).alias("id"), doubles(vec_col).alias("raw")).where(F.col("raw").isNotNull() & (F.size("raw") > 0)).where(norm(F.col("raw")) > 0)
    rows = materialize(known.select("id", F.transform("raw", lambda x: x / norm(F.col("raw"))).alias("v")), "units")
    reps = materialize(rows.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies")).select("id", "v", "copies"), "representatives")
    alone = reps.where("copies = 1").select(F.col("id").alias("rep"), "id")
    several = rows.join(reps.where("copies > 1").select(F.col("id").alias("rep"), "v"), "v").select("rep", "id")
    return reps.select("id", "v"), alone.unionByName(several)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


Places = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _dealt(reps: DataFrame, places: Places, vectors: bool) -> DataFrame:
    """A row for each vector and place: cell, ring, side (0 at home, 1 visiting), same (visits its own ring), id and, if asked for, v."""
    kind, step = dict(reps.dtypes)["id"], DEALT if vectors else HOMES

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                row, cell, ring, side, same = places(_matrix(part.column("v")))
                take = pa.array(row, pa.int64())
                columns = [pa.array(cell, pa.int32()), pa.array(ring, pa.int64()), pa.array(side, pa.int32()), pa.array(same, pa.int32()), part.column("id").take(take)]
                yield pa.RecordBatch.from_arrays(columns + [part.column("v").take(take)] * vectors, names=["cell", "ring", "side", "same", "id"] + ["v"] * vectors)

    return reps.mapInArrow(each, f"{PLACE}, id {kind}" + ", v array<double>" * vectors)


def _joined(reps: DataFrame, members: DataFrame, places: Places, threshold: float) -> Join:
    """All pairs that share a place and whose cosine is over the threshold, once each."""
    kind = dict(reps.dtypes)["id"]
    counts = _dealt(reps, places, False).groupBy("cell", "ring").agg(F.count(F.when(F.col("side") == 0, 1)).alias("homes"), F.count(F.when(F.col("side") == 1, 1)).alias("visits"))
    counts = materialize(counts.where("homes > 0 AND visits > 0"), "places")
    blocks = counts.select("cell", "ring", F.ceil(F.col("homes") / HOMES).cast("int").alias("_homes"), F.ceil(F.col("visits") / VISITORS).cast("int").alias("_visits"))
    rows = _dealt(reps, places, True).join(F.broadcast(blocks) if small(blocks) else blocks, ["cell", "ring"])
    own = lambda n: F.array(F.pmod(F.xxhash64("id"), F.col(n)).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    home = F.col("side") == 0
    rows = rows.withColumn("a", F.explode(F.when(home, own("_homes")).otherwise(every("_homes")))).withColumn("b", F.explode(F.when(home, every("_visits")).otherwise(own("_visits"))))

    def product(table: pa.Table) -> pa.Table:
        side, same = table["side"].to_numpy(), table["same"].to_numpy()
        at, to = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        v, ids = _matrix(table["v"].combine_chunks()), table["id"].to_numpy()
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k in range(0, len(at), HOMES):
            mine = at[k : k + HOMES]
            c = v[mine] @ v[to].T
            x, y = np.nonzero(c > threshold)
            p, q = ids[mine[x]], ids[to[y]]
            keep = np.where(same[mine[x]] == 1, p < q, p != q)
            found.append((np.minimum(p, q)[keep], np.maximum(p, q)[keep], c[x, y][keep]))
        i, j, c = (np.concatenate(x) if found else np.zeros(0) for x in (list(zip(*found)) or [()] * 3))
        return pa.table([pa.array(i.astype(ids.dtype)), pa.array(j.astype(ids.dtype)), pa.array(c.astype(np.float64))], names=["i", "j", "cos"])

    pairs = rows.select("cell", "ring", "a", "b", "side", "same", "id", "v").groupBy("cell", "ring", "a", "b").applyInArrow(product, f"i {kind}, j {kind}, cos double")
    return Join(pairs.groupBy("i", "j").agg(F.max("cos").alias("cos")), members, counts)


def pivots_of(reps: DataFrame, count: int, sample: int = SAMPLE) -> np.ndarray:
    """At most `count` vectors far from each other, picked one by one from the `sample` rows of the least hashes."""
    rows = reps.select("v", F.xxhash64("id").alias("h")).orderBy("h").limit(sample).toArrow()
    if not len(rows):
        return np.zeros((0, 0))
    x = _matrix(rows["v"].combine_chunks())
    chosen, near = [0], np.full(len(x), np.inf)
    while True:
        near = np.minimum(near, np.linalg.norm(x - x[chosen[-1]], axis=1))
        if len(chosen) == min(count, len(x)) or near.max() <= 1e-9:
            return x[chosen]
        chosen.append(int(near.argmax()))


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2 * x @ p.T, 0))


def exact_join(vectors: DataFrame, threshold: float, id_col: str = "id", vec_col: str = "embedding", pivots: int = 64) -> Join:
    """All pairs whose cosine is over the threshold (below 1), pruned by the triangle inequality.

    On the unit sphere such a pair is nearer than r = sqrt(2 - 2 threshold). Each vector is at home at its nearest pivot, in
    the ring of width r that its distance falls in. It visits a later pivot's rings only if that pivot is at most 2 r farther than its own, and of any
    pivot only the rings within r of its distance. How much that saves depends on the data: nothing where r is near the usual distance of two vectors.
    """
    reps, members = units(vectors, id_col, vec_col)
    points = pivots_of(reps, pivots)
    r = float(np.sqrt(max(2 - 2 * threshold, 0))) + 1e-7

    def places(x: np.ndarray):
        d = _distances(x, points)
        home = d.argmin(axis=1)
        n, own = np.arange(len(x)), d[np.arange(len(x)), home]
        ring = np.floor(own / r).astype(np.int64)
        later = (np.arange(len(points))[None, :] > home[:, None]) & (d - own[:, None] <= 2 * r)
        row, cell = np.nonzero(later)
        first, last = np.floor((d[row, cell] - r) / r).astype(np.int64), np.floor((d[row, cell] + r) / r).astype(np.int64)
        rows, cells, rings, sides, same = [n, n, n], [home, home, home], [ring, ring, ring + 1], [0 * n, 0 * n + 1, 0 * n + 1], [0 * n, 0 * n + 1, 0 * n]
        for step in range(int((last - first).max(initial=-1)) + 1):
            fits = first + step <= last
            rows.append(row[fits])
            cells.append(cell[fits])
            rings.append((first + step)[fits])
            sides.append(np.ones(fits.sum(), np.int64))
            same.append(np.zeros(fits.sum(), np.int64))
        return tuple(np.concatenate(c) for c in (rows, cells, rings, sides, same))

    return _joined(reps, members, places, threshold)


def bands_for(threshold: float, recall: float, bits: int) -> int:
    """Bands of so many bits in which a pair at the threshold meets at least once with the given probability."""
    together = (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** bits
    return max(1, int(np.ceil(np.log(1 - recall) / np.log1p(-min(together, 1 - 1e-12)))))


def approximate_join(vectors: DataFrame, threshold: float, recall: float = 0.95, id_col: str = "id", vec_col: str = "embedding", bits: int | None = None, seed: int = 42) -> Join:
    """Pairs whose cosine is over the threshold, each found with probability `recall` at least; those found are exact.

    The signs of `bits` random projections are a key; two vectors at the threshold agree in one with probability (1 - angle / pi) ^ bits,
    which sets the number of keys. More bits mean fewer vectors under a key but more keys; without a choice they follow the number of vectors.
    """
    reps, members = units(vectors, id_col, vec_col)
    n = reps.count()
    bits = bits or int(np.clip(np.ceil(np.log2(max(n, 2) / 256)), 4, 24))
    bands = bands_for(threshold, recall, bits)
    first = reps.select(F.size("v").alias("d")).first()
    planes = np.random.default_rng(seed).normal(size=(first.d if first else 1, bands * bits))
    weights = 1 << np.arange(bits, dtype=np.int64)

    def places(x: np.ndarray):
        keys = ((x @ planes > 0).reshape(len(x), bands, bits) * weights).sum(axis=2).ravel()
        row, cell = np.repeat(np.arange(len(x)), bands), np.tile(np.arange(bands), len(x))
        zero, one = np.zeros(len(row), np.int64), np.ones(len(row), np.int64)
        return np.concatenate([row, row]), np.concatenate([cell, cell]), np.concatenate([keys, keys]), np.concatenate([zero, one]), np.concatenate([zero, one])

    return _joined(reps, members, places, threshold)


def all_pairs(join: Join) -> DataFrame:
    """i, j, cos of all rows, copies written out: as many as the square of a class; for small data."""
    left, right = (join.members.select(F.col("rep").alias(r), F.col("id").alias(n)) for r, n in (("_a", "_i"), ("_b", "_j")))
    between = join.pairs.join(left, F.col("i") == F.col("_a")).join(right, F.col("j") == F.col("_b")).select(F.least("_i", "_j").alias("i"), F.greatest("_i", "_j").alias("j"), "cos")
    within = left.join(right, F.col("_a") == F.col("_b")).where("_i < _j").select(F.col("_i").alias("i"), F.col("_j").alias("j"), F.lit(1.0).alias("cos"))
    return between.unionByName(within)
