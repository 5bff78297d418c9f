"""Approximate nearest neighbours by largest inner product: forests of random-projection trees.

Copies of a vector are one point, with its smallest ids. A trunk, one random-projection tree fitted on a sample of at most
``SAMPLE_FLOATS`` numbers, sends every point to one cell and every query to the cells that lie nearest in the trunk's own
queue: all of up to ``PROBES`` cells. Of more, how many is measured on the table itself: at most ``CALIBRATED`` of its queries meet all points by brute force, and
queries visit as many cells as hold ``COVERED`` of what these find. Vectors with structure need few cells, random ones nearly all,
so their work grows with queries times rows. A cell's rows are indexed by a forest grown on all of them. All trees' leaves form one priority queue, ordered by the squared distances between the query and the hyperplanes that part
it from the leaf; the first ``DRAINED`` of the queue are drained, each giving its points a vote that weighs more the
nearer the leaf is. The points with most votes, ``SCORED`` times the square root of the cell's points, are the leaf candidates, which are ranked
exactly, with correctly rounded sums. The best of a query's cells are merged.

An extra coordinate turns inner products into angles. A point keeps as many of its smallest ids as a result can use, and equal queries are
searched once, so copies need no pairs. A cell of more rows than ``CELL_FLOATS`` numbers (more cells than the sample can tell apart, or
vectors that no direction parts) is dealt by hash into blocks that its queries all visit, and many queries of a cell into parts.

Recall is measured against brute force in tests/llm/test_ann.py; 0.9 is the least allowed.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with a
null id. Vectors meet only vectors of as many components. Rows equal in id and vector are one row; an id that repeats with other vectors may be
found once for each, but never by a query of that id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolode.llm.tables import read
from chronolode.session import cut_lineage

TREES, LEAF, DRAINED, SCORED, STEP = 56, 32, 0.5, 4.4, 32
SAMPLE_FLOATS, SAMPLE_EACH, CELL_FLOATS, QUERY_FLOATS, PROBES = 1 << 22, 16, 1 << 20, 1 << 22, 8
CALIBRATED, COVERED = 128, 0.97


class Tree(NamedTuple):
    """A complete tree: one hyperplane a level, and a threshold for each node of each level."""

    planes: np.ndarray  # components by levels
    thresholds: list[np.ndarray]

    def leaves(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point; the bits of its number are the sides taken, the root's first."""
        at = np.zeros(len(points), np.int64)
        for side, cut in zip((points @ self.planes).T, self.thresholds):
            at = 2 * at + (side >= cut[at])
        return at

    def distances(self, queries: np.ndarray) -> np.ndarray:
        """Queries by leaves: the squared distances from the hyperplanes that part the query from the leaf, summed."""
        out = np.zeros((len(queries), 1), np.float32)
        for side, cut in zip((queries @ self.planes).T, self.thresholds):
            margin = np.subtract.outer(side, cut).astype(np.float32)
            both = np.empty((*out.shape, 2), np.float32)
            for k, beyond in enumerate((np.maximum(margin, 0), np.minimum(margin, 0))):
                np.multiply(beyond, beyond, out=beyond)
                np.add(out, beyond, out=both[:, :, k])
            out = both.reshape(len(queries), -1)
        return out


def grow(points: np.ndarray, levels: int, rng: np.random.Generator) -> tuple[Tree, np.ndarray]:
    """A tree of random directions whose nodes are split at their medians, and the leaf of each point.

    Nodes of a level are the rows of a table, filled up with places for no point that lie above all points.
    """
    planes = rng.standard_normal((points.shape[1], levels))
    planes /= np.linalg.norm(planes, axis=0)
    sides = np.r_[points @ planes, np.full((1, levels), np.inf)]  # the last is no point's
    order, thresholds = np.full(-(-len(points) // (1 << levels)) << levels, len(points)), []
    order[: len(points)] = np.arange(len(points))
    for k in range(levels):
        nodes = order.reshape(1 << k, -1)
        half = nodes.shape[1] // 2
        values = sides[nodes, k]
        parted = np.argpartition(values, half, axis=1)
        thresholds.append(np.take_along_axis(values, parted[:, half : half + 1], axis=1)[:, 0])
        order = np.take_along_axis(nodes, parted, axis=1).ravel()
    leaves = np.empty(len(points) + 1, np.int64)
    leaves[order] = np.repeat(np.arange(1 << levels), len(order) >> levels)
    return Tree(planes, thresholds), leaves[:-1]


def lifted(points: np.ndarray, largest: float) -> np.ndarray:
    """Points with the coordinate that gives them all the norm ``largest``, so that inner products order as angles do."""
    return np.c_[points, np.sqrt(np.maximum(largest**2 - np.einsum("ij,ij->i", points, points), 0))]


def aimed(queries: np.ndarray, largest: float) -> np.ndarray:
    """Queries stretched to the norm ``largest``, with a zero for the extra coordinate."""
    return np.c_[queries * (largest / np.linalg.norm(queries, axis=1, keepdims=True)), np.zeros(len(queries))]


def levels_for(points: int, each: int) -> int:
    return max(0, math.ceil(math.log2(max(1, points) / each)))


def nearest_points(points: np.ndarray, queries: np.ndarray, k: int, seed: int = 4) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query (rows of float64) the candidates' rows in ``points`` that may be among its ``k`` nearest found, and their rough products."""
    n = len(points)
    largest = np.linalg.norm(points, axis=1).max()
    rng, high = np.random.default_rng(seed), lifted(points / largest, 1.0)
    trees, leaves = zip(*(grow(high, levels_for(n, LEAF), rng) for _ in range(TREES)))
    want = min(n, max(4 * k, math.ceil(SCORED * math.sqrt(n))))
    # rounding of a product of d terms, for the longest point
    slack = 4e-16 * points.shape[1] * largest
    step = max(1, min(STEP, (1 << 24) // (n + TREES * (2 * n // LEAF + 1))))
    for at in range(0, len(queries), step):
        some = queries[at : at + step]
        goal = aimed(some, 1.0)
        queue = np.stack([t.distances(goal) for t in trees])  # trees, queries, leaves
        drained = max(0, math.ceil(DRAINED * queue.shape[0] * queue.shape[2]) - 1)
        last = np.partition(queue.transpose(1, 0, 2).reshape(len(some), -1), drained, axis=1)[:, drained]
        votes = np.zeros((n, len(some)), np.float32)
        for distance, leaf in zip(queue, leaves):
            votes += np.take(np.ascontiguousarray(np.maximum(last[:, None] - distance, 0).T), leaf, axis=0)
        votes = np.ascontiguousarray(votes.T)
        for i, q in enumerate(some):
            best = np.argpartition(votes[i], n - want)[n - want :]
            rough = points[best] @ q
            if len(best) > k:
                least = np.partition(rough, -k)[-k]
                near = rough >= least - slack * np.linalg.norm(q)
                best, rough = best[near], rough[near]
            yield best, rough


def nearest_in_cell(points: np.ndarray, owners: list[list[int]], query_keys: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query key, row id, inner product): each query's best ``k`` rows of the cell. ``owners``: each point's smallest ids."""
    out = []
    exact = points.astype(np.float64)
    asked = queries.astype(np.float64)
    for key, q, (best, _) in zip(query_keys.tolist(), asked, nearest_points(exact, asked, k)):
        found = []
        for p in best.tolist():
            score = math.fsum((exact[p] * q).tolist())
            found += [(-score, r) for r in owners[p]]
        found.sort()
        out += [(key, r, -s) for s, r in found[:k]]
    return out


def matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


class Trunk(NamedTuple):
    """Of vectors of one length: the tree over cells and the largest norm."""

    tree: Tree
    largest: float


def fit_trunks(points: DataFrame) -> tuple[dict[int, Trunk], DataFrame]:
    """A trunk for each length that has more rows than fit a cell, and the number of rows by length.

    A trunk is fitted on the rows of smallest hash, at most ``SAMPLE_FLOATS`` numbers; only lengths with that many rows have one, and
    those by falling number of rows while the samples together keep to that bound. Others have one cell, dealt into blocks that every
    query visits: the bounds are on the fit, no row and no length is left out of the search.
    """
    sizes = cut_lineage(points.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max("square").alias("square")), 1)
    large = sizes.where(F.col("n") * F.col("dim") > CELL_FLOATS).orderBy(F.desc("n"), "dim").limit(64).collect()
    trunks: dict[int, Trunk] = {}
    rest = SAMPLE_FLOATS
    for r in large:
        rows = min(rest // r["dim"], r["n"])
        cells = min(-(-r["n"] * r["dim"] // CELL_FLOATS), rows // SAMPLE_EACH)
        if cells < 2:
            continue
        # of hashes spread evenly, those under the share that holds about so many rows; the limit holds the bound
        share = int(min(1.0, 1.1 * rows / r["n"]) * (1 << 62))
        mine = points.where(F.col("dim") == r["dim"]).where(F.shiftrightunsigned(F.xxhash64(F.lit(9), "h"), 2) <= share).select("v").limit(rows).toArrow()
        sample = matrix(mine.column("v"), len(mine)).astype(np.float64)
        if len(sample) < 2 * SAMPLE_EACH:
            continue
        largest = math.sqrt(r["square"])
        trunks[r["dim"]] = Trunk(grow(lifted(sample, largest), levels_for(cells, 1), np.random.default_rng(7))[0], largest)
        rest -= rows * r["dim"]
    return trunks, sizes


def in_cells(points: DataFrame, trunks: dict[int, Trunk]) -> DataFrame:
    """``points`` (dim, h, v, owners) with the ``cell`` of each."""
    fields = {f.name: f.dataType.simpleString() for f in points.schema}
    names = ["dim", "h", "v", "owners"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cells = np.zeros(len(dims), np.int32)
            for dim in np.unique(dims).tolist():
                trunk, mine = trunks.get(dim), np.flatnonzero(dims == dim)
                if trunk is not None:
                    v = matrix(batch.column("v").take(pa.array(mine)), len(mine)).astype(np.float64)
                    cells[mine] = trunk.tree.leaves(lifted(v, trunk.largest))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(cells)], names=[*names, "cell"])

    return points.select(*names).mapInArrow(run, ", ".join(f"{n} {fields[n]}" for n in names) + ", cell int")


def visits(queries: DataFrame, trunks: dict[int, Trunk], probes: dict[int, int]) -> DataFrame:
    """``queries`` (dim, query_key, v) with ``cells``, the ``probes`` nearest cells of each: a list, so that vectors are stored once."""
    fields = {f.name: f.dataType.simpleString() for f in queries.schema}
    names = ["dim", "query_key", "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                trunk, mine = trunks.get(dim), np.flatnonzero(dims == dim)
                step = max(1, (1 << 22) >> len(trunk.tree.thresholds)) if trunk else len(mine)
                for at in range(0, len(mine), step):
                    some = batch.take(pa.array(mine[at : at + step]))
                    near = np.zeros((len(some), 1), np.int64)
                    if trunk is not None:
                        far = trunk.tree.distances(aimed(matrix(some.column("v"), len(some)).astype(np.float64), trunk.largest))
                        n = min(probes[dim], far.shape[1])
                        near = np.argpartition(far, n - 1, axis=1)[:, :n]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1) * near.shape[1], pa.int32()), pa.array(near.ravel(), pa.int32()))
                    yield pa.RecordBatch.from_arrays([*(some.column(c) for c in names), lists], names=[*names, "cells"])

    return queries.select(*names).mapInArrow(run, ", ".join(f"{n} {fields[n]}" for n in names) + ", cells array<int>")


def calibrated(placed: DataFrame, queries: DataFrame, trunks: dict[int, Trunk], k: int) -> dict[int, int]:
    """How many cells a query visits, by length: the fewest, ``PROBES`` at least, that hold ``COVERED`` of the true neighbours of sampled queries.

    Queries of smallest hash are the sample; what they find is the ``k`` nearest points but their own, in one pass over all points.
    """
    probes = dict.fromkeys(trunks, PROBES)
    sample: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim, trunk in trunks.items():
        if 1 << len(trunk.tree.thresholds) > PROBES:
            some = queries.where(F.col("dim") == dim).orderBy(F.xxhash64(F.lit(11), "h"), "query_key").limit(CALIBRATED).select("h", "v").toArrow()
            if len(some):
                sample[dim] = some.column("h").to_numpy(), matrix(some.column("v"), len(some)).astype(np.float64)
    if not sample:
        return probes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {dim: (np.full((len(h), k), -np.inf), np.zeros((len(h), k), np.int32)) for dim, (h, _) in sample.items()}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in sample.keys() & set(np.unique(dims).tolist()):
                some = batch.take(pa.array(np.flatnonzero(dims == dim)))
                own, asked = sample[dim]
                products = asked @ matrix(some.column("v"), len(some)).astype(np.float64).T
                products[own[:, None] == some.column("h").to_numpy()] = -np.inf
                scores = np.c_[best[dim][0], products]
                cells = np.c_[best[dim][1], np.broadcast_to(some.column("cell").to_numpy(), products.shape)]
                keep = np.argpartition(scores, -k, axis=1)[:, -k:]
                best[dim] = np.take_along_axis(scores, keep, axis=1), np.take_along_axis(cells, keep, axis=1)
        for dim, (scores, cells) in best.items():
            at, place = np.nonzero(scores > -np.inf)
            columns = [pa.array(np.full(len(at), dim), pa.int32()), pa.array(at, pa.int32()), pa.array(scores[at, place]), pa.array(cells[at, place])]
            yield pa.RecordBatch.from_arrays(columns, names=["dim", "at", "score", "cell"])

    found = placed.select("dim", "h", "v", "cell").mapInArrow(run, "dim int, at int, score double, cell int")
    place = F.row_number().over(Window.partitionBy("dim", "at").orderBy(F.desc("score"), "cell"))
    true = found.withColumn("place", place).where(F.col("place") <= k).select("dim", "at", "cell").toArrow()
    dims, at, cell = (true.column(c).to_numpy() for c in ("dim", "at", "cell"))
    for dim, (_, asked) in sample.items():
        mine = dims == dim
        if mine.any():
            far = trunks[dim].tree.distances(aimed(asked, trunks[dim].largest))
            needed = np.array([(far[q] <= far[q, c]).sum() for q, c in zip(at[mine], cell[mine])])
            probes[dim] = max(PROBES, int(np.quantile(needed, COVERED, method="higher")))
    return probes


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows of ``vectors`` found for each row of ``queries``."""

    def usable(df: DataFrame, name: str) -> DataFrame:
        v = F.col(vector_col)
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.select(F.col(id_col).cast("long").alias(name), v.alias("v")).where(F.col(name).isNotNull() & fine).withColumn("h", F.xxhash64("v"))

    # a point is a vector with its k + 1 smallest ids: one may be the query's own; what is cut off is cut before the exchange
    first = F.dense_rank().over(Window.partitionBy("h", "v").orderBy("vec_id"))
    owned = usable(vectors, "vec_id").withColumn("place", first).where(F.col("place") <= k + 1)
    points = owned.groupBy("h", "v").agg(F.sort_array(F.collect_set("vec_id")).alias("owners"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    points = cut_lineage(points.withColumns({"dim": F.size("v"), "square": square}))
    asked = usable(queries, "query_id").withColumn("dim", F.size("v"))
    distinct = cut_lineage(asked.groupBy("h", "v", "dim").agg(F.min("query_id").alias("query_key")))

    trunks, sizes = fit_trunks(points)
    placed = cut_lineage(in_cells(points, trunks))
    visited = cut_lineage(visits(distinct, trunks, calibrated(placed, distinct, trunks, k)))
    aimed_at = visited.select("dim", "query_key", "v", F.explode("cells").alias("cell"))
    keys = ["dim", "cell"]
    n_blocks = F.ceil(F.count(F.lit(1)) * F.col("dim") / CELL_FLOATS / 2).cast("int")  # cells of a sampled tree are uneven
    n_parts = F.ceil(F.count(F.lit(1)) * F.col("dim") / QUERY_FLOATS).cast("int")
    counts = cut_lineage(placed.groupBy(*keys).agg(n_blocks.alias("blocks")).join(aimed_at.groupBy(*keys).agg(n_parts.alias("parts")), keys), 1)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.join(counts, keys).select(*keys, F.pmod(F.xxhash64(F.lit(1), "h"), "blocks").cast("int").alias("block"), every("parts").alias("part"), "owners", "v")
    right = aimed_at.join(counts, keys).select(*keys, every("blocks").alias("block"), F.pmod(F.xxhash64(F.lit(2), "query_key"), "parts").cast("int").alias("part"), "query_key", "v")

    def solve(cell: pa.Table, part: pa.Table) -> pa.Table:
        names = ["query_key", "vec_id", "score"]
        found: list[tuple[int, int, float]] = []
        if len(cell) and len(part):
            found = nearest_in_cell(matrix(cell.column("v"), len(cell)), cell.column("owners").to_pylist(), part.column("query_key").to_numpy(), matrix(part.column("v"), len(part)), k + 1)
        return pa.table([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=names)

    group = [*keys, "block", "part"]
    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(solve, "query_key long, vec_id long, score double")
    best = Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    lists = top.groupBy("query_key").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("top"))
    # each copy of a query takes the list without itself
    named = distinct.join(lists, "query_key").select("h", "v", "top")
    own = asked.select("query_id", "h", "v").distinct().join(named, ["h", "v"]).withColumn("top", F.slice(F.filter("top", lambda x: x["vec_id"] != F.col("query_id")), 1, k))
    rows = own.select("query_id", F.posexplode("top").alias("at", "x"))
    return rows.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
