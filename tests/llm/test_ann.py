import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from chronolode.llm import ann as op

SF = "/root/testdata/sf0.1"


def brute(ids, vectors, query_ids, k):
    out = {}
    exact = vectors.astype(np.float64)
    where = {int(i): n for n, i in enumerate(ids)}
    for q in query_ids:
        rough = exact @ exact[where[int(q)]]
        near = [n for n in np.argsort(-rough)[: k + 40] if ids[n] != q]
        out[int(q)] = sorted((-math.fsum((exact[n] * exact[where[int(q)]]).tolist()), int(ids[n])) for n in near)[:k]
    return out


def test_recall_and_scores(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32)
    want = brute(ids, vectors, [i for i in ids if i % 20 == 0], 20)
    got = {}
    for r in op.op4_nearest_neighbours(spark, SF).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want) and all([x[0] for x in sorted(g)] == list(range(1, 21)) for g in got.values())
    exact = {(q, v): -s for q, rs in want.items() for s, v in rs}
    found = [exact.get((q, v)) == s for q, g in got.items() for _, v, s in g]
    assert np.mean(found) >= 0.9
    assert all([(-s, v) for _, v, s in sorted(g)] == sorted((-s, v) for _, v, s in g) for g in got.values())


def recall_of(vectors, queries, k=20):
    """Share found of the nearest rows but the query's own, and the share of rows scored."""
    ids = np.arange(len(vectors))
    want = brute(ids, vectors, queries, k)
    found = op.nearest_points(vectors.astype(np.float64), vectors[queries].astype(np.float64), k + 1)
    got = {int(q): set(best.tolist()) for q, (best, _) in zip(queries, found)}
    return np.mean([len(got[q] & {v for _, v in w}) / k for q, w in want.items()])


def test_recall_in_a_large_cell():
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((16_000, 64)).astype(np.float32)
    assert recall_of(vectors, rng.choice(16_000, 60, replace=False)) >= 0.9
    assert op.SCORED * 16_000**0.5 <= 0.04 * 16_000 and op.SCORED * 2000**0.5 < 0.1 * 2000
    # of very different norms, and around a few centres
    assert recall_of(vectors[:4000] * rng.exponential(1, (4000, 1)).astype(np.float32), np.arange(0, 4000, 100)) >= 0.9
    centres = rng.standard_normal((20, 64)) * 4
    assert recall_of((centres[rng.integers(0, 20, 8000)] + rng.standard_normal((8000, 64))).astype(np.float32), np.arange(0, 8000, 200)) >= 0.9


def test_recall_through_cells(spark):
    """50 000 rows without structure, the hardest case, over several cells."""
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((50_000, 64)).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(50_000), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(vectors.ravel()), 64).cast(pa.list_(pa.float32()))}))
    asked = list(range(0, 50_000, 500))
    want = brute(np.arange(50_000), vectors, asked, 20)
    got = {}
    for r in op.nearest(df, df.where("vec_id % 500 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & {v for _, v in want[q]}) / 20 for q in asked]) >= 0.9


def test_a_tree_parts_at_medians_and_measures_from_its_planes():
    rng = np.random.default_rng(5)
    points = rng.standard_normal((1000, 6))
    tree, leaves = op.grow(points, 4, rng)
    assert (tree.leaves(points) == leaves).all() and sorted(np.bincount(leaves)) == [55] + [63] * 15
    q = points[:3]
    far = tree.distances(q)
    for i in range(3):
        for leaf in range(16):
            total, node = 0.0, 0
            for k in range(4):
                margin, side = q[i] @ tree.planes[:, k] - tree.thresholds[k][node], leaf >> (3 - k) & 1
                total += margin**2 if (margin >= 0) != side else 0.0
                node = 2 * node + side
            assert abs(far[i, leaf] - total) < 1e-4
        assert far[i, leaves[i]] == 0


def run(spark, rows, k=2, queries="vec_id % 20 = 0"):
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, dim int")
    return sorted(map(tuple, op.nearest(df, df.where(queries), k).collect()))


def test_ties_copies_and_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (9, [1.0, 0.0]), (5, [1.0, 0.0]), (3, [0.5, 0.0]), (20, None), (40, [0.0, 0.0]), (60, [nan, 1.0]), (80, [inf, 1.0]), (100, [None, 1.0]), (120, []), (7, [1.0]), (None, [9.0, 9.0]), (140, [2.0])]
    assert run(spark, rows) == [(0, 1, 5, 1.0), (0, 2, 9, 1.0), (140, 1, 7, 2.0)]
    assert run(spark, [(0, [1.0])]) == [] and run(spark, []) == []
    assert run(spark, [(0, [1.0, 1.0]), (1, [3.0, 0.0]), (2, [-1.0, 0.0])], k=5) == [(0, 1, 1, 3.0), (0, 2, 2, -1.0)]


def test_hot_vector_blocks_and_parts(spark, monkeypatch):
    monkeypatch.setattr(op, "CELL_FLOATS", 400)
    monkeypatch.setattr(op, "QUERY_FLOATS", 40)
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(300)] + [(i, rng.standard_normal(4).astype(np.float32).tolist()) for i in range(300, 700)]
    got = [r for r in run(spark, rows, k=20) if r[0] < 300]
    assert {q: [r[2] for r in got if r[0] == q] for q in range(0, 300, 20)} == {q: [i for i in range(21) if i != q][:20] for q in range(0, 300, 20)}
    # without a trunk a cell's blocks hold all rows between them
    monkeypatch.setattr(op, "SAMPLE_FLOATS", 0)
    assert [r for r in run(spark, rows, k=20) if r[0] < 300] == got


def test_repeated_rows_and_ids(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (1, [0.0, 3.0]), (20, [5.0, 1.0])]
    got = run(spark, rows, k=5)
    assert [r for r in got if r[0] == 20] == sorted(got) and {r[2] for r in got} == {1}


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert op.nearest(df, df.limit(0)).count() == 0 and op.nearest(df.limit(0), df).count() == 0


def test_recall_with_more_cells_than_probes(spark, monkeypatch):
    """Vectors without structure over 32 cells: as many are visited as hold the neighbours; around centres few are."""
    monkeypatch.setattr(op, "CELL_FLOATS", 1 << 12)
    probes, calibrate = [], op.calibrated
    monkeypatch.setattr(op, "calibrated", lambda *a: probes.append(calibrate(*a)) or probes[-1])
    rng = np.random.default_rng(6)
    noise = rng.standard_normal((8000, 16)).astype(np.float32)
    centres = rng.standard_normal((32, 16)) * 20
    for vectors in (noise, (centres[rng.integers(0, 32, 8000)] + noise).astype(np.float32)):
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
        df = spark.createDataFrame(pa.table({"vec_id": np.arange(8000), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(vectors.ravel()), 16).cast(pa.list_(pa.float32()))}))
        want = brute(np.arange(8000), vectors, range(0, 8000, 100), 20)
        got = {}
        for r in op.nearest(df, df.where("vec_id % 100 = 0")).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        assert np.mean([len(got[q] & {v for _, v in w}) / 20 for q, w in want.items()]) >= 0.9
    assert probes[0][16] > probes[1][16] >= op.PROBES
