"""Small histories as landing frames: a list of commits, each with its touched paths."""

from chronolode.plans.ingest import build_model
from chronolode.schema import RAW_COMMITS, RAW_ENTRIES

START, HOUR = 1_704_067_200_000, 3_600_000
NOW = 1_772_668_800_000
JAVA_PLAIN = "class X { void f() { g(); } }"
JAVA_NESTED = "class X { int f(int a) { if (a > 0) { if (a > 1) { return 2; } } return 1; } }"


def history(spark, commits, disk=None, mailmap=None, max_paths=50, now=NOW):
    """``commits``: dicts with ``paths`` (path, or (path, status, added, deleted)) and optional author, message, parents, at."""
    raw, entries, seen = [], [], set()
    for k, c in enumerate(commits):
        name, email = c.get("author", ("Test Author", "test@example.com"))
        raw.append((f"h{k:03d}", k, c.get("at", START + k * HOUR), name, email, c.get("message", f"commit {k}"), c.get("parents", 1)))
        for p in c["paths"]:
            p = p if isinstance(p, tuple) else (p, "M" if p in seen else "A", 1, 0)
            seen.add(p[0])
            entries.append((f"h{k:03d}", *p))
    disk = {p: JAVA_PLAIN for p in {e[1] for e in entries}} if disk is None else disk
    tree = spark.createDataFrame([(p, bytearray(c if isinstance(c, bytes) else c.encode())) for p, c in disk.items()], "path string, content binary")
    return build_model(spark.createDataFrame(raw, RAW_COMMITS), spark.createDataFrame(entries, RAW_ENTRIES), tree, now, mailmap, max_paths)
