"""What must not change as tables grow: what the driver holds, and that nothing is cut."""

from conftest import SF

from chronolode import registry
from chronolode.operators import coupling
from chronolode.plans.graph import connected_components
from chronolode.plans.model import RepoModel

EDGE = "file_a_id long, file_b_id long, co_changes int, total_changes_a int, total_changes_b int"


def test_recent_cluster_is_counted_once_without_broadcasts_of_files(spark, monkeypatch):
    """The driver collects neither all files nor all totals, and pairs are counted from the changes once."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    files = spark.createDataFrame([(i, f"f{i}") for i in range(4)], "file_id long, path string")
    m = RepoModel(None, files, None, None, spark.createDataFrame([(0, 1, 1, 1, 1)], EDGE))
    assert "Broadcast" not in plan(coupling._named_edges(coupling.pair_ratios(m, None, smaller=False), m))
    commits = spark.createDataFrame([(1, 5)], "commit_id long, author_date long")
    touched = spark.createDataFrame([(1, 0), (1, 1)], "commit_id long, file_id long")
    assert plan(coupling.coupling_since(touched, commits, 0)).count("ShuffledHashJoin") == 2
    counted, count = [], coupling.coupling_since
    monkeypatch.setattr(coupling, "coupling_since", lambda *a: counted.append(1) or count(*a))
    registry.q_cluster_file_since(spark, SF).collect()
    assert len(counted) == 1


def test_queries_have_no_cap_of_edges(spark, monkeypatch):
    """The cap belongs to the request; the queries, as their SQL, take all edges, beyond it by the distributed loop."""
    run = lambda q: sorted(map(tuple, q(spark, SF).collect()))
    queries = registry.q_cluster_since, registry.q_cluster_members
    want = [run(q) for q in queries]
    assert all(len(w) > 2 for w in want)
    monkeypatch.setattr(coupling, "EDGE_CAP", 2)
    assert [run(q) for q in queries] == want


def test_clusters_beyond_the_cap(spark):
    """12 720 edges: 160 files that all meet, and a pair apart."""
    ids = spark.range(160)
    pairs = ids.selectExpr("id AS file_a_id").crossJoin(ids.selectExpr("id AS file_b_id")).where("file_a_id < file_b_id").union(spark.createDataFrame([(200, 201)], "file_a_id long, file_b_id long"))
    m = RepoModel(None, spark.range(300).selectExpr("id AS file_id", "cast(id AS string) AS path"), None, None, pairs.selectExpr("*", "1 AS co_changes", "1 AS total_changes_a", "1 AS total_changes_b"))
    got = coupling.coupling_clusters(m, min_size=2, capped=False).collect()
    assert [(len(r.files), len(r.edges), r.avgCoupling) for r in got] == [(160, 12_720, 1.0), (2, 1, 1.0)]


def test_rounds_do_not_multiply_size_estimates(spark):
    """A chain of mixed numbers takes several rounds; the driver's estimate of its labels stays a number of ordinary length."""
    chain = [(i * 37 % 101, (i + 1) * 37 % 101) for i in range(100)]
    labels = connected_components(spark.createDataFrame(chain, "src long, dst long"))
    assert {tuple(r) for r in labels.collect()} == {(i, 0) for i in range(101)}
    assert len(str(labels._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 60
