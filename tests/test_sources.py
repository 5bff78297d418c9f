import json
import os
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from chronolode.functions.scalar import extension, is_binary_path, line_count, ticket_slug
from chronolode.plans.complexity import java_complexity
from chronolode.plans.coupling import build_coupling
from chronolode.plans.engine import Engine
from chronolode.plans.graph import connected_components
from chronolode.streaming.incremental import IncrementalIndex


def git(repo, *args, at=None):
    when = {} if at is None else {"GIT_AUTHOR_DATE": f"@{at} +0000", "GIT_COMMITTER_DATE": f"@{at} +0000"}
    env = os.environ | {"GIT_CONFIG_NOSYSTEM": "1", "HOME": str(repo)} | when
    subprocess.run(["git", "-c", "user.name=Test Author", "-c", "user.email=test@example.com", "-c", "safe.directory=*", "-C", str(repo), *args], check=True, capture_output=True, env=env)


def commit(repo, at, message="m", **files):
    for name, text in files.items():
        path = repo / name.replace("__", "/")
        if text is None:
            path.unlink()
        else:
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text)
    git(repo, "add", "-A")
    git(repo, "commit", "-q", "-m", message, at=at)


def test_git_index_update_and_refresh(spark, tmp_path):
    repo = tmp_path / "r"
    repo.mkdir()
    git(repo, "init", "-q", "-b", "main")
    engine = Engine(spark, repo=str(repo), now_ms=1_772_668_800_000)
    assert engine.refresh_index()["commitsProcessed"] == 0
    commit(repo, 1704067200, "ABC-1 one", foo__App="class X {}\n")
    assert engine.update_index()["commitsProcessed"] == 1 and engine.update_index()["commitsProcessed"] == 0
    commit(repo, 1704070800, "two", foo__App="class X {\n}\n")
    git(repo, "mv", "foo/App", "moved")
    os.makedirs(repo / "bar")
    git(repo, "mv", "moved", "bar/App")
    git(repo, "commit", "-q", "-m", "three", at=1704074400)
    commit(repo, 1704078000, "four", bar__App="class  X {\n}\n")
    assert engine.update_index()["commitsProcessed"] == 3
    m = engine.model
    assert [r.path for r in m.files.collect()] == ["bar/App"] and m.file_changes.count() == 4
    assert m.commits.where("first_line = 'ABC-1 one'").first().jira_slug == "ABC-1"
    # of white space only: touched, without lines
    assert sorted((r.commit_id, r.lines_added, r.lines_deleted) for r in m.file_changes.collect()) == [(0, 1, 0), (1, 2, 1), (2, 2, 0), (3, 0, 0)]
    before = sorted(map(tuple, m.file_changes.collect()))
    (repo / ".mailmap").write_text("# people\nProper Name <test@example.com>\n")
    assert engine.refresh_index()["commitsProcessed"] == 4 and sorted(map(tuple, engine.model.file_changes.collect())) == before
    assert {r.author_name for r in engine.model.commits.collect()} == {"Proper Name"}


def test_an_index_is_there_again(spark, tmp_path):
    """Built, dropped, opened again, brought up to date: the same as a full build."""
    repo, at = tmp_path / "r", str(tmp_path / "index")
    repo.mkdir()
    git(repo, "init", "-q", "-b", "main")
    commit(repo, 1704067200, "one", App="class X { void f() { if (a) b(); } }\n", **{"B.java": "class B { void f() { } }\n", "notes": "a\nb\n"})
    commit(repo, 1704070800, "two", App="class X { }\n", **{"C.java": "class C { void f() { if (a) b(); } }\n"})
    first = Engine(spark, repo=str(repo), now_ms=1_772_668_800_000, path=at)
    assert first.call("get_summary").is_error
    result = json.loads(first.call("refresh_index").text)
    assert (result["status"], result["commitsProcessed"], result["filesIndexed"], result["errorMessage"]) == ("ok", 2, 2, None)
    del first
    commit(repo, 1704074400, "three", App="class X {\n}\n", **{"C.java": "class C { void f() { while (a) b(); if (c) d(); } }\n", "notes": None})
    again = Engine(spark, repo=str(repo), now_ms=1_772_668_800_000, path=at)
    assert json.loads(again.call("get_index_status").text)["status"] == "ready" and json.loads(again.call("get_summary").text)["totalCommits"] == 2
    result = again.update_index()
    assert (result["status"], result["commitsProcessed"], result["filesIndexed"]) == ("ok", 1, 1)
    whole = Engine(spark, repo=str(repo), now_ms=1_772_668_800_000)
    whole.refresh_index()
    for t in ("commits", "files", "file_changes", "file_metrics", "file_coupling"):
        assert sorted(map(tuple, getattr(again.model, t).collect()), key=str) == sorted(map(tuple, getattr(whole.model, t).collect()), key=str), t
    # in the background, and after the branch was written anew
    git(repo, "reset", "-q", "--hard", "HEAD~2")
    commit(repo, 1704078000, "other", App="class Y {\n}\n")
    third = Engine(spark, repo=str(repo), now_ms=1_772_668_800_000, path=at)
    worker = third.start()
    assert third.status.state in ("indexing", "ready")
    worker.join()
    assert third.status.as_dict()["status"] == "ready" and sorted(r.first_line for r in third.model.commits.collect()) == ["one", "other"]
    # a failed build says so and is tried again
    third.repo = str(tmp_path / "gone")
    assert json.loads(third.call("refresh_index").text)["status"] == "error" and json.loads(third.call("get_index_status").text)["status"] == "error"


def test_git_fields_may_hold_anything(spark, tmp_path):
    """Record separators, tabs and figures in subjects and names; such and bytes that are no UTF-8 in paths."""
    repo = tmp_path / "r"
    repo.mkdir()
    git(repo, "init", "-q", "-b", "main")
    odd = "a\x1eb\x1fc\td"
    commit(repo, 1704067200, f"ABC-7 {odd} :100644", **{"1\t2\tx": "1\n", odd: "1\n2\n"})
    with open(os.path.join(os.fsencode(repo), b"na\xefve"), "wb") as f:
        f.write(b"x\n")
    (repo / "0123456789012345678901234567890123456789").write_text("h\n")
    (repo / "Odd.java").write_bytes(b"class O { String s = \"\xff\xfe\"; void f() { if (a) b(); } }")
    git(repo, "add", "-A")
    git(repo, "-c", f"user.name=N {odd}", "commit", "-q", "--allow-empty-message", "-m", "", at=1704070800)
    engine = Engine(spark, repo=str(repo), now_ms=1_772_668_800_000)
    assert engine.refresh_index()["commitsProcessed"] == 2
    rows = {r.path: (r.lines_added, r.first_line) for r in engine.model.file_changes.join(engine.model.files, "file_id").join(engine.model.commits, "commit_id").collect()}
    subject = f"ABC-7 {odd} :100644"
    assert rows == {"1\t2\tx": (1, subject), odd: (2, subject), "na\ufffdve": (1, ""), "0123456789012345678901234567890123456789": (1, ""), "Odd.java": (1, "")}
    assert {r.path: r.cyclomatic_complexity for r in engine.model.file_metrics.join(engine.model.files, "file_id").collect()}["na\ufffdve"] == -1
    assert engine.model.file_metrics.where("cyclomatic_complexity = 2").count() == 1


def test_git_merges_and_deletions(spark, tmp_path):
    repo = tmp_path / "r"
    repo.mkdir()
    git(repo, "init", "-q", "-b", "main")
    commit(repo, 1704067200, a="1\n", b="1\n")
    git(repo, "checkout", "-q", "-b", "side")
    commit(repo, 1704070800, c="1\n")
    git(repo, "checkout", "-q", "main")
    commit(repo, 1704074400, d="1\n", b=None)
    git(repo, "merge", "-q", "--no-ff", "-m", "merge", "side", at=1704078000)
    engine = Engine(spark, repo=str(repo), now_ms=1_772_668_800_000)
    assert engine.refresh_index()["commitsProcessed"] == 4
    m = engine.model
    assert m.commits.where("is_merge").count() == 1
    names = m.file_changes.join(m.files, "file_id").join(m.commits, "commit_id")
    assert [(r.path, r.lines_added) for r in names.where("is_merge").collect()] == [("c", 0)]
    assert sorted(r.path for r in m.file_metrics.join(m.files, "file_id").collect()) == ["a", "c", "d"]


def test_scalars(spark):
    df = spark.createDataFrame([("  ABC-12: x",), ("A-1",), ("ABCDE-1",), ("abc-1",), (None,)], "s string")
    assert [r[0] for r in df.select(ticket_slug(F.col("s"))).collect()] == ["ABC-12", None, None, None, None]
    df = spark.createDataFrame([("Makefile",), ("a.d/Makefile",), ("x.tar.gz",), (".gitignore",), ("x.PNG",)], "s string")
    assert [tuple(r) for r in df.select(extension(F.col("s")), is_binary_path(F.col("s"))).collect()] == [("(no ext)", False), (".d/Makefile", False), (".gz", True), (".gitignore", False), (".PNG", True)]
    df = spark.createDataFrame([("line1\nline2\nline3\n",), ("",), ("line1\nline2",), ("a\0b",), ("a\r\nb",), (None,)], "s string")
    assert [r[0] for r in df.select(line_count(F.col("s"))).collect()] == [4, 0, 2, None, 2, None]


@pytest.mark.parametrize("source, want", [
    ("class A { int f(int a) { if (a > 0) { if (a > 1) { return 2; } } return 1; } }", (3, 3)),
    ("class A { void g() { x(); } }", (1, 0)),
    ("class A { A(int x) { if (x > 0) y = 1; else y = 2; } }", (2, 2)),
    ("class A { boolean f(boolean a, boolean b) { return a && b && a || b; } }", (4, 2)),
    ("class A { String s = \"if (x) { while(\"; // for (;;) {\n void f() { } }", (1, 0)),
    ("class A { void f() { for (int i : x) { try { g(); } catch (E e) { if (i > 0) h(); } } } }", (4, 6)),
    ("interface I { int X = 3; void f(); }", (-1, -1)),
])
def test_complexity(source, want):
    assert java_complexity(source)[1:] == want


@pytest.mark.parametrize("source, want", [
    ("class A { void f() { " + "if (a) b(); else " * 3000 + "c(); } }", (3001, 3001)),
    ("class A { void f() { " + "if (a) { " * 2500 + "}" * 2500 + " } }", (2501, 2500 * 2501 // 2)),
    ("class A { void f() { " + "{" * 30_000 + "}" * 30_000 + " } }", (1, 0)),
    ("class A { void f() { x = " + "a -> { return " * 2000 + "1" + "; }" * 2000 + "; } }", (1, 0)),
    ("class A { void f() { if (", (2, 1)),
])
def test_deep_nesting(source, want):
    assert java_complexity(source)[1:] == want


def test_a_file_that_fails_is_counted(spark, monkeypatch):
    from chronolode.plans import complexity

    failures = spark.sparkContext.accumulator(0)
    rows = [("a.java", bytearray(b"class A { void f() { } }\n\n")), ("b.java", bytearray(b"\xff\n")), ("c.txt", bytearray(b"x\n\n")), ("d.bin", bytearray(b"\0")), ("e.java", bytearray(b"")), ("f", None)]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = sorted(map(tuple, complexity.file_metrics(df, failures).collect()))
    assert got == [("a.java", 1, 1, 0), ("b.java", 1, -1, -1), ("c.txt", 3, -1, -1), ("e.java", 0, -1, -1), ("f", 0, -1, -1)] and failures.value == 0


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()))
    assert got == {x: root(x) for x in parent}


def test_increments_equal_a_full_build(spark, tmp_path):
    rng = random.Random(2)
    rows = [(c, c % 5 == 0, f, 1, 0) for c in range(60) for f in rng.sample(range(12), rng.randrange(1, 7))]
    schema = "commit_id long, is_merge boolean, file_id long, lines_added int, lines_deleted int"
    df = spark.createDataFrame(rows, schema)
    full = sorted(map(tuple, build_coupling(df, df.select("commit_id", "is_merge").distinct(), 5).collect()))
    cuts = {c: rng.randrange(4) for c in range(60)}
    for k in range(4):
        index = IncrementalIndex(spark, str(tmp_path / "index"), 5)  # opened anew each time
        part = spark.createDataFrame([r for r in rows if cuts[r[0]] == k], schema)
        index.absorb(part)
        index.absorb(part)  # a second time: nothing new
    assert sorted(map(tuple, index.coupling().collect())) == full and index.changes().count() == len(rows)


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    schema = "commit_id long, is_merge boolean, file_id long, lines_added int, lines_deleted int"
    rows = [(c, False, f, 1, 0) for c in range(6) for f in (c, c + 1, 9)]
    for k in range(2):
        spark.createDataFrame(rows[9 * k : 9 * k + 9], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "landing"))
        IncrementalIndex(spark, str(tmp_path / "index"), 5).run_available(str(tmp_path / "landing"), schema, str(tmp_path / "checkpoint"))
    df = spark.createDataFrame(rows, schema)
    full = sorted(map(tuple, build_coupling(df, df.select("commit_id", "is_merge").distinct(), 5).collect()))
    index = IncrementalIndex(spark, str(tmp_path / "index"), 5)
    assert sorted(map(tuple, index.coupling().collect())) == full and index.changes().count() == len(rows)
