import os
import random
import re
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
from pyspark.sql import functions as F

from chronolode.llm import decontaminate as op

SF = "/root/testdata/sf0.01"


def test_equals_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = sorted(map(tuple, op.op8_decontamination(spark, SF).collect()))
    assert got == sorted(c.sql(op.OP8_SQL).fetchall()) and got


def pairs(spark, docs, items):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    return sorted(tuple(r) for r in op.contained_items(df, spark.createDataFrame(items, "item_id long, text string")).collect())


def test_threshold_signatures_and_long_documents(spark):
    words = [f"w{i}" for i in range(24)]  # 20 shingles: four may be missing
    item = " ".join(words)
    filler = " ".join(f"f{i % 997}" for i in range(50_000))
    cut = {d: filler + " " + " ".join(words[: 24 - d]) + ". " + filler for d in (0, 4, 5)}
    assert pairs(spark, [(d, t) for d, t in cut.items()], [(1, item)]) == [(0, 1, 20, 20), (4, 1, 20, 16)]
    # the same shingles far apart, upper case, other signs between
    apart = f" {filler} ".join([" ".join(words[:14]), " ".join(words[10:])]).upper().replace(" ", ",\n")
    assert pairs(spark, [(1, apart)], [(1, item)]) == [(1, 1, 20, 20)]


ITEMS = [(k, " ".join(f"i{k}w{j}" for j in range(n))) for k, n in enumerate((5, 6, 9, 14, 29, 40))]


def test_every_subset_of_missing_shingles_is_searched():
    items = op.index_items(ITEMS)
    for k, n in enumerate((5, 6, 9, 14, 29, 40)):
        for lost in range(n):
            text = " ".join("zz" if j == lost else f"i{k}w{j}" for j in range(n))
            have = n - 4 - len([s for s in range(n - 4) if s <= lost < s + 5])
            assert op.found(items, ["other text", text])[:1] == ([(1, k, n - 4, have)] if have >= 0.8 * (n - 4) - 1e-9 else [])


def test_only_signatures_are_searched():
    """A document that holds an item but for its signature gives no candidate, and nothing is counted."""
    items = op.index_items(ITEMS)
    assert [len(p.code) for p in items.parts] == [1, 1, 2, 3, 6, 8] and all((p.code <= p.last).all() for p in items.parts)
    start, end = items.ends[4], items.ends[5]
    rows, code = items.shingles[start:end], items.code[start:end]
    own = np.isin(code, np.concatenate([p.code for p in items.parts]))
    assert own.sum() == 8 and op.candidates(items, code[~own], np.zeros((~own).sum(), int)) == set()
    assert op.candidates(items, code[own], np.zeros(8, int)) == {(0, 5)} and op.shared_shingles(items, 5, rows[~own], code[~own]) == 28


def brute(docs, items):
    cut = lambda t: {tuple(w[i : i + min(5, len(w))]) for w in [re.findall(r"\w+", (t or "").lower())] for i in range(len(w) - min(5, len(w)) + 1) if w}
    out = []
    for i in {i for i, _ in items}:
        mine = set().union(*(cut(t) for j, t in items if j == i))
        for d, t in docs:
            both = len(mine & cut(t))
            if mine and both >= 0.8 * len(mine):
                out.append((d, i, len(mine), both))
    return sorted(out)


def test_equals_brute_force_on_crowded_words(spark):
    """Few words, so that documents and items share most of their shingles and many items are near the threshold."""
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(k, text(rng.randrange(1, 60))) for k in range(60)]
    docs = [(d, text(rng.choice((0, 3, 4, 5, 40, 300)))) for d in range(120)] + [(900 + k, text(30) + " " + t + " " + text(30)) for k, t in items]
    got = pairs(spark, docs, items)
    assert got == brute(docs, items) and len(got) > 100


def test_repeated_ids_equal_sql(spark):
    words = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(words[:12])), (1, " ".join(words[:12])), (2, " ".join(words[20:28])), (2, " ".join(words[30:40]))]
    docs = [(1, " ".join(words[:14])), (2, " ".join(words[18:30])), (3, " ".join(words[19:40])), (3, " ".join(words[19:40]))]
    c = duckdb.connect()
    for t, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        c.execute(f"CREATE TABLE {t} ({key} BIGINT, text VARCHAR)")
        c.executemany(f"INSERT INTO {t} VALUES (?, ?)", rows)
    got = pairs(spark, docs, items)
    assert got == sorted(r[:4] for r in c.sql(op.OP8_SQL).fetchall()) == [(1, 1, 8, 8), (3, 2, 10, 10)]


def test_workers_need_no_package(tmp_path):
    """Workers that start elsewhere, without the repository on their path, run the operator."""
    root = str(Path(op.__file__).parents[2])
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "def absent(_):\n    import importlib.util\n    return [importlib.util.find_spec('chronolode') is None]\n"
        "assert spark.sparkContext.parallelize([1], 1).mapPartitions(absent).first()\n"
        "from chronolode.llm import decontaminate as op\n"
        "d = spark.createDataFrame([(1, 'x a b c d e f y'), (2, 'z')], 'doc_id long, text string')\n"
        "i = spark.createDataFrame([(7, 'a b c d e f')], 'item_id long, text string')\n"
        "assert [tuple(r) for r in op.contained_items(d, i).collect()] == [(1, 7, 2, 2)] and [r[0] for r in op.clean_documents(d, i).collect()] == [2]\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH" and not k.startswith("SPARK")}
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env=env, timeout=300)


def test_nulls_short_and_repeated(spark):
    docs = [(1, None), (2, ""), (3, "a b c"), (4, "x a b c y"), (None, "p q r s t"), (5, "p q r s t"), (5, "p q r s t")]
    items = [(1, "A, b; C"), (2, None), (3, ""), (4, "p q r s t"), (None, "p q r s t")]
    got = sorted((tuple(r) for r in op.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()), key=str)
    assert got == sorted([(3, 1, 1, 1)] + [(d, i, 1, 1) for d in (None, 5) for i in (4, None)], key=str)


def test_empty_tables_and_filter(spark):
    docs = spark.createDataFrame([(1, "p q r s t u", "k"), (2, "p q r", "k"), (3, None, "k")], "doc_id long, text string, sent string")
    items = spark.createDataFrame([(1, "p q r s t")], "item_id long, text string")
    assert op.contained_items(docs, items.limit(0)).count() == 0 and op.contained_items(docs.limit(0), items).count() == 0
    kept = op.clean_documents(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    assert op.clean_documents(docs, items.limit(0)).count() == 3


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(op, "ITEM_BYTES", 60)
    items = [(k, " ".join(f"b{k}v{j}" for j in range(8))) for k in range(12)]
    docs = [(k, "lead " + t) for k, t in items] + [(99, "clean text of no item at all")]
    assert [r[:2] for r in pairs(spark, docs, items)] == [(k, k) for k in range(12)]
    kept = op.clean_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert [r.doc_id for r in kept.collect()] == [99]
