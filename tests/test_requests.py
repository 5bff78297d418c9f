import json

import pytest
from repo_frames import HOUR, JAVA_NESTED, JAVA_PLAIN, NOW, START, history

from chronolode.operators import changes, coupling, overview, people
from chronolode.plans.engine import Engine, IndexStatus
from chronolode.plans.ingest import build_changes
from chronolode.plans.model import RepoModel
from chronolode.plans.renames import resolve_renames
from chronolode.sources.mailmap import mailmap_frame, parse_mailmap, resolve_identities

SINCE_2025 = 1_735_689_600_000


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def abc(spark):
    return history(spark, [{"paths": ["src/A.java", "src/B.java"]}, {"paths": ["src/A.java", "src/B.java"]}, {"paths": ["src/A.java", "src/B.java", "src/C.java"]}])


def test_hotspots_order_scores_and_window(spark):
    m = history(spark, [{"paths": ["Main.java", "Helper.java"]}, {"paths": ["Main.java"]}, {"paths": ["Main.java"]}], {"Main.java": JAVA_NESTED, "Helper.java": JAVA_PLAIN})
    got = changes.hotspots(m, NOW, 5).collect()
    assert [(r.path, r.changeFrequency, r.cyclomaticComplexity, r.hotspotScore) for r in got] == [("Main.java", 3, 3, 1.0), ("Helper.java", 1, 1, 0.0)]
    assert got[0].ageInDays == 794 and "first_ms" not in got[0].asDict()
    assert rows(changes.hotspots(m, NOW, since_ms=SINCE_2025)) == []
    assert len(rows(changes.hotspots(m, NOW, top_n=1))) == 1


def test_single_text_file_scores_by_lines(spark):
    m = history(spark, [{"paths": ["src/app.ts"]}] * 2, {"src/app.ts": "a\nb\n"})
    r = changes.hotspots(m, NOW, 1, extension=".ts").first()
    assert (r.linesOfCode, r.cyclomaticComplexity, r.hotspotScore) == (3, -1, 1.0)


def test_path_filters_ignore_case_and_have_wildcards(spark):
    m = history(spark, [{"paths": ["src/service/Auth.java", "src/util/StringUtils.java", "test/AuthTest.java", "a_b.txt", "axb.txt"]}])
    paths = lambda **k: sorted(r.path for r in changes.hotspots(m, NOW, **k).collect())
    assert paths(path_filter="src/service/%") == ["src/service/Auth.java"]
    assert paths(path_filter="SRC/%", extension=".java") == ["src/service/Auth.java", "src/util/StringUtils.java"]
    assert paths(path_filter="a_b%") == ["a_b.txt", "axb.txt"]
    assert paths(path_filter="nonexistent/%") == [] and paths(path_filter="src\\%") == []


def test_churn(spark):
    m = history(spark, [{"paths": [("Main.java", "A", 5, 0), ("Helper.java", "A", 1, 0)]}, {"paths": [("Main.java", "M", 2, 0)]}, {"paths": [("Main.java", "M", 1, 1)]}])
    assert rows(changes.churn(m, 5)) == [("Main.java", 8, 1, 9, 3), ("Helper.java", 1, 0, 1, 1)]


def test_coupling_pairs_and_partners(abc):
    # which of a pair comes first follows file ids, hashes of the paths
    pairs = [({r.fileA[4], r.fileB[4]}, r.coChanges, {r.totalChangesA, r.totalChangesB}, r.couplingRatio) for r in coupling.temporal_coupling(abc, min_coupling=0.1).collect()]
    assert pairs[0] == ({"A", "B"}, 3, {3}, 1.0) and all(p[1:] == (1, {1, 3}, 1.0) for p in pairs[1:]) and len(pairs) == 3
    assert rows(coupling.file_coupling(abc, "src/A.java", 1, 0.9)) == [("src/B.java", 3, 3, 3, 1.0)]
    since = coupling.file_coupling(abc, "src/A.java", 1, 0.9, since_ms=START + HOUR // 2)
    assert [r.coChanges for r in since.collect()] == [2]
    assert rows(coupling.file_coupling(abc, "nope")) == [] and rows(coupling.temporal_coupling(abc, since_ms=SINCE_2025)) == []
    with pytest.raises(ValueError, match="filePath is required"):
        coupling.file_coupling(abc, " ")


def test_merges_and_bulk_commits_count_only_in_totals(spark):
    bulk = [f"f{i:02d}" for i in range(51)]
    m = history(spark, [{"paths": ["a", "b"], "parents": 2}, {"paths": bulk}, {"paths": bulk[:50]}])
    assert rows(coupling.temporal_coupling(m, min_coupling=0.0, file_filter="a")) == []
    pair = coupling.temporal_coupling(m, 1, 0.0, file_filter="f00").first()
    assert (pair.coChanges, pair.totalChangesA, pair.couplingRatio) == (1, 2, 0.5)
    assert coupling.temporal_coupling(m, 5, 0.0, file_filter="a", since_ms=0).first().coChanges == 1
    assert coupling.temporal_coupling(m, 1, 0.0, file_filter="f50", since_ms=0).first().couplingRatio == 1.0


@pytest.fixture(scope="module")
def two_groups(spark):
    auth, repo = ["auth/Login.java", "auth/Auth.java"], ["repo/UserRepo.java", "repo/OrderRepo.java"]
    return history(spark, [{"paths": auth}] * 3 + [{"paths": repo}] * 3)


def test_clusters(two_groups):
    run = lambda **k: coupling.coupling_clusters(two_groups, **k).collect()
    got = run(min_size=2)
    assert [(r.clusterIndex, r.files, r.avgCoupling, len(r.edges)) for r in got] == [
        (1, ["auth/Auth.java", "auth/Login.java"], 1.0, 1), (2, ["repo/OrderRepo.java", "repo/UserRepo.java"], 1.0, 1),
    ]
    assert got[0].edges[0].coChanges == 3
    assert run() == [] and run(min_size=1, max_size=1) == [] and run(min_size=2, path_filter="service/%") == [] and run(min_size=2, min_coupling=1.1) == []
    assert len(run(min_size=2, path_filter="auth/%")) == 1 and run(min_size=2, path_filter="AUTH/%") == []
    assert len(run(min_size=2, since_ms=0)) == 2
    one = coupling.cluster_of_file(two_groups, "auth/Login.java").collect()
    assert [(r.clusterIndex, r.files) for r in one] == [(1, ["auth/Auth.java", "auth/Login.java"])]
    assert coupling.cluster_of_file(two_groups, "unknown").collect() == []
    assert coupling.cluster_of_file(two_groups, "auth/Login.java", max_size=1).collect() == []


def test_weak_edges_inside_a_cluster(spark):
    ids = {"a": 1, "b": 2, "c": 3}
    files = spark.createDataFrame([(v, k) for k, v in ids.items()], "file_id long, path string")
    edges = spark.createDataFrame([(1, 2, 9, 10, 10), (2, 3, 9, 10, 10), (1, 3, 1, 10, 10), (1, 4, 1, 0, 0)], "file_a_id long, file_b_id long, co_changes int, total_changes_a int, total_changes_b int")
    m = RepoModel(None, files, None, None, edges)
    whole = coupling.coupling_clusters(m, 0.3).first()
    assert len(whole.edges) == 2 and whole.avgCoupling == pytest.approx(0.9)
    single = coupling.cluster_of_file(m, "a", 0.3).first()
    assert len(single.edges) == 3 and single.avgCoupling == pytest.approx(1.9 / 3)


def test_edge_cap(spark):
    files = spark.range(200).selectExpr("id AS file_id", "cast(id AS string) AS path")
    pairs = spark.range(200).selectExpr("id AS file_a_id").crossJoin(spark.range(200).selectExpr("id AS file_b_id")).where("file_a_id < file_b_id")
    edge = pairs.orderBy("file_a_id", "file_b_id").selectExpr("*", "1 AS co_changes", "1 AS total_changes_a", "1 AS total_changes_b")
    with pytest.raises(coupling.EdgeCapReached):
        coupling.coupling_clusters(RepoModel(None, files, None, None, edge.limit(10_000)))
    assert coupling.coupling_clusters(RepoModel(None, files, None, None, edge.limit(9_999))).count() == 1


def test_history(spark):
    m = history(spark, [{"paths": ["src/Main.java"], "message": s} for s in ("ABC-1 initial commit", "ABC-2 add method", "  ABC-3: refactor")])
    got = overview.file_history(m, "src/Main.java").collect()
    assert [r.jiraSlug for r in got] == ["ABC-3", "ABC-2", "ABC-1"] and got[0].filesChanged == ["src/Main.java"]
    count = lambda **k: overview.file_history(m, "src/Main.java", **k).count()
    assert (count(jira_slug="ABC-2"), count(jira_slug="abc-%"), count(jira_slug="XYZ-%"), count(limit=1)) == (1, 3, 0, 1)


def test_authors_bus_factor_and_ownership(spark):
    alice, bob = ("Alice", "alice@x"), ("Bob", "bob@x")
    main, helper, tied = ("Main.java", "M", 1, 0), ("Helper.java", "M", 1, 0), ("Tied.java", "M", 0, 0)
    m = history(spark, [{"paths": [main], "author": alice}] * 3 + [{"paths": [main], "author": bob}] + [{"paths": [helper], "author": bob}] * 2 + [{"paths": [tied], "author": a} for a in (alice, bob)] * 2)
    assert rows(people.file_authors(m, "Main.java")) == [("alice@x", "Alice", 3), ("bob@x", "Bob", 1)]
    assert [(r[0], r[1], r[5]) for r in rows(people.bus_factor(m, threshold=0.5))] == [
        ("Helper.java", "bob@x", 1.0), ("Main.java", "alice@x", 0.75), ("Tied.java", "alice@x", 0.5), ("Tied.java", "bob@x", 0.5),
    ]
    assert rows(people.bus_factor(m, threshold=1.1)) == [] and rows(people.bus_factor(m, threshold=0, since_ms=SINCE_2025)) == []
    assert {(r[0], r[5]) for r in rows(people.ownership(m, by="lines"))} == {("Main.java", 0.75), ("Helper.java", 1.0)}
    assert [r[0] for r in rows(people.ownership(m, min_ownership=0.9, extension="java"))] == ["Helper.java"]
    with pytest.raises(ValueError, match="banana"):
        people.ownership(m, by="banana")


def test_stale_files(spark):
    m = history(spark, [{"paths": ["Complex.java", "Simple.java", "gone.txt"]}], {"Complex.java": JAVA_NESTED, "Simple.java": JAVA_PLAIN})
    got = changes.stale_files(m, NOW, min_days_stale=365).collect()
    assert [(r.filePath, r.loc, r.cyclomaticComplexity, r.stalenessScore) for r in got] == [("Complex.java", 1, 3, 1.0), ("Simple.java", 1, 1, 0.0), ("gone.txt", 0, -1, 0.0)]
    assert rows(changes.stale_files(m, NOW, min_days_stale=1000)) == [] and rows(changes.stale_files(m, NOW, extension=".ts")) == []


def test_summary_and_status(spark):
    m = history(spark, [{"paths": ["Main.java", "Helper.java"]}, {"paths": ["Main.java"]}, {"paths": ["Main.java"]}])
    engine = Engine(spark, now_ms=NOW)
    for name in set(engine.requests) - {"get_index_status", "refresh_index"}:
        assert engine.call(name, filePath="x") == ("Index not ready (status: not_started). Call get_index_status to check progress.", True)
    assert json.loads(engine.call("get_index_status").text) == {"status": "not_started"}
    engine = Engine(spark, m, now_ms=NOW)
    got = json.loads(engine.call("get_summary").text)
    assert (got["totalCommits"], got["totalFilesTracked"], got["uniqueAuthors"], got["earliestCommitMs"], got["latestCommitMs"]) == (3, 2, 1, START, START + 2 * HOUR)
    assert got["languageDistribution"] == [{"extension": ".java", "fileCount": 2}] and got["topChangedFiles"][0] == {"filePath": "Main.java", "changeFrequency": 3}
    assert json.loads(engine.call("get_hotspots", topN=1).text)[0]["path"] == "Main.java"
    status = IndexStatus()
    assert status.as_dict() == {"status": "not_started"}
    status.begin(5)
    assert status.as_dict() == {"status": "indexing", "startedAtMs": 5}
    status.finish(1239)
    assert status.as_dict()["elapsedMs"] == 1234
    status.fail("boom")
    assert status.as_dict() == {"status": "error", "startedAtMs": 5, "errorMessage": "boom"}


def test_answers_and_errors(spark, abc):
    engine = Engine(spark, abc, now_ms=NOW)
    got = json.loads(engine.call("get_file_commit_history", filePath="src/A.java", limit=1.0, sinceEpochMs=None, other="x").text)
    assert len(got) == 1 and got[0]["jiraSlug"] is None and list(got[0]) == ["hash", "authorDate", "firstLine", "jiraSlug", "filesChanged"]
    for name in ("get_file_commit_history", "get_file_authors", "get_file_coupling"):
        assert engine.call(name) == engine.call(name, filePath=" ") == ("filePath is required", True)
        assert engine.call(name, filePath="nope") == ("[]", False)
    assert engine.call("get_ownership", ownershipBy="banana").is_error and "banana" in engine.call("get_ownership", ownershipBy="banana").text
    assert engine.call("get_nothing") == ("Unknown request: get_nothing", True)
    wrong = engine.call("get_hotspots", topN="many")
    assert wrong.is_error and wrong.text.startswith("get_hotspots failed: ")
    broken = RepoModel(abc.commits.drop("author_date"), abc.files, abc.file_changes, abc.file_metrics, abc.file_coupling)
    assert Engine(spark, broken).call("get_churn", sinceEpochMs=1).text.startswith("get_churn failed: ")
    clusters = json.loads(engine.call("get_coupling_clusters", minClusterSize=2, filePath="").text)
    assert clusters[0]["clusterIndex"] == 1 and set(clusters[0]["edges"][0]) == {"fileA", "fileB", "coChanges", "couplingRatio"}


def test_filters_go_before_sums(spark, abc):
    """With a path filter the change table meets the files before it is aggregated."""
    plans = [changes.churn(abc, path_filter="src/A%"), changes.hotspots(abc, NOW, extension=".java"), changes.stale_files(abc, NOW, extension=".java"), people.ownership(abc, path_filter="src/%"), people.bus_factor(abc, path_filter="src/%")]
    for df in plans:
        text = df._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftSemi" in text[text.index("Aggregate [file_id") :]


def test_a_long_chain_and_a_far_component(spark):
    """One file's cluster: a chain longer than the frontier's rounds, and none of the others."""
    chain = [(i, i + 1, 9, 10, 10) for i in range(40)] + [(100, 101, 9, 10, 10), (40, 41, 1, 10, 10)]
    files = spark.createDataFrame([(i, f"f{i:03d}") for i in range(110)], "file_id long, path string")
    edges = spark.createDataFrame(chain, "file_a_id long, file_b_id long, co_changes int, total_changes_a int, total_changes_b int")
    m = RepoModel(None, files, None, None, edges)
    assert coupling.cluster_of_file(m, "f020").first().files == [f"f{i:03d}" for i in range(41)]
    assert coupling.cluster_of_file(m, "f100").first().files == ["f100", "f101"] and coupling.cluster_of_file(m, "f105").collect() == []


def test_empty_repository(spark):
    m = history(spark, [{"paths": ["x"], "message": None}])
    empty = RepoModel(*(getattr(m, t).limit(0) for t in ("commits", "files", "file_changes", "file_metrics", "file_coupling")))
    assert rows(changes.hotspots(empty, NOW)) == [] and rows(coupling.coupling_clusters(empty)) == []
    assert tuple(overview.summary_scalars(empty).first()) == (0, 0, 0, 0, 0, 0)


def resolved(spark, *entries):
    return {(r.ord, r.path): r.final_path for r in resolve_renames(spark.createDataFrame(list(entries), "ord long, path string, status string")).collect()}


def test_long_chain_of_renames(spark):
    entries = [(0, "d0/F", "A")] + [x for k in range(1, 26) for x in ((k, f"d{k - 1}/F", "D"), (k, f"d{k}/F", "A"))]
    assert set(resolved(spark, *entries).values()) == {"d25/F"}


def test_renames(spark):
    assert resolved(spark, (0, "foo/Bar", "A"), (1, "foo/Bar", "D"), (1, "bar/Bar", "A"), (2, "bar/Bar", "M")) == {(0, "foo/Bar"): "bar/Bar", (1, "bar/Bar"): "bar/Bar", (2, "bar/Bar"): "bar/Bar"}
    # the target was there before
    assert resolved(spark, (0, "b/F", "A"), (1, "a/F", "A"), (2, "b/F", "D"), (3, "a/F", "D"), (3, "b/F", "A"))[1, "a/F"] == "a/F"
    # two hops, then the first name again
    chain = resolved(spark, (0, "a/F", "A"), (1, "a/F", "D"), (1, "b/F", "A"), (2, "b/F", "D"), (2, "c/F", "A"), (3, "a/F", "A"))
    assert chain == {(0, "a/F"): "c/F", (1, "b/F"): "c/F", (2, "c/F"): "c/F", (3, "a/F"): "a/F"}
    # two candidates
    assert resolved(spark, (0, "x/F", "A"), (1, "x/F", "D"), (1, "y/F", "A"), (1, "z/F", "A"))[0, "x/F"] == "x/F"


def test_deleted_binary_and_duplicate_entries(spark):
    m = history(spark, [{"paths": ["Keep.java", "logo.bin"]}, {"paths": ["Gone.java"]}, {"paths": [("Gone.java", "D", 0, 3)]}], {"Keep.java": JAVA_PLAIN, "logo.bin": b"\x00\x01", "other.java": JAVA_PLAIN})
    assert [r.path for r in m.file_metrics.join(m.files, "file_id").collect()] == ["Keep.java"]
    assert overview.file_history(m, "Gone.java").count() == 2 and overview.file_history(m, "logo.bin").count() == 1
    from chronolode.schema import RAW_COMMITS, RAW_ENTRIES

    raw = spark.createDataFrame([("h", 0, 0, "n", "e", "m", 1)], RAW_COMMITS)
    entries = spark.createDataFrame([("h", "p.png", "A", 5, 0), ("h", "p.png", "A", 5, 0)], RAW_ENTRIES)
    assert [tuple(r) for r in build_changes(raw.union(raw), entries).collect()] == [(0, "p.png", 0, 0)]


def test_mailmap(spark):
    lines = ["# comment", "", "Proper <c1@x>", "<p2@x> <c2@x>", "Proper Three <p3@x> <c3@x>", "Proper Four <p4@x> Commit Four <c4@x>", "Second <p9@x> <c3@x>", "no address"]
    assert parse_mailmap(lines) == [
        (0, "Proper", None, None, "c1@x"), (1, None, "p2@x", None, "c2@x"), (2, "Proper Three", "p3@x", None, "c3@x"),
        (3, "Proper Four", "p4@x", "Commit Four", "c4@x"), (4, "Second", "p9@x", None, "c3@x"),
    ]
    who = spark.createDataFrame([("N", "C1@x"), ("N", "c2@x"), ("N", "C3@X"), ("commit FOUR", "c4@x"), ("Other", "c4@x"), ("N", "zz"), (None, None)], "raw_name string, raw_email string")
    got = {(r.raw_name, r.raw_email): (r.author_name, r.author_email) for r in resolve_identities(who, mailmap_frame(spark, lines)).collect()}
    assert got == {
        ("N", "C1@x"): ("Proper", "C1@x"), ("N", "c2@x"): ("N", "p2@x"), ("N", "C3@X"): ("Proper Three", "p3@x"), ("commit FOUR", "c4@x"): ("Proper Four", "p4@x"),
        ("Other", "c4@x"): ("Other", "c4@x"), ("N", "zz"): ("N", "zz"), (None, None): (None, None),
    }
    m = history(spark, [{"paths": ["A.java"], "author": a} for a in (("Al", "old1@x"), ("Al", "old2@x"), ("A", "alice@x"))], mailmap=mailmap_frame(spark, ["Alice <alice@x> <old1@x>", "Alice <alice@x> <old2@x>"]))
    assert [r.commitCount for r in people.file_authors(m, "A.java").collect()] == [3]
