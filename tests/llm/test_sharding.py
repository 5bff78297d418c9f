import zlib
from collections import Counter

from chronolode.llm import sharding as op
from chronolode.session import shared_path

SF = "/root/testdata/sf0.01"


def slots_are_gapless(rows, shard, slot):
    by = {}
    for r in rows:
        by.setdefault(r[shard], []).append(r[slot])
    return all(sorted(s) == list(range(len(s))) for s in by.values()), Counter({k: len(v) for k, v in by.items()})


def test_whole_table(spark):
    docs = dict(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()))
    rows = op.op6_sharding(spark, SF).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {d: (len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in docs.items()}
    gapless, counts = slots_are_gapless(rows, "shard", "slot")
    assert gapless and len(rows) == len(docs) and set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def test_many_buckets_nulls_and_clashes(spark):
    texts = [(None, None), (None, None), (1, ""), (1, ""), (2, "é")] + [(i, "w" * i) for i in range(3, 400)]
    df = spark.createDataFrame([(*t, "x", 5) for t in texts], "doc_id long, text string, _shard string, bucket int")
    out = op.shard_documents(df, 7, shared_path(spark, "t"), bucket_bytes=5000)
    rows = out.collect()
    gapless, counts = slots_are_gapless(rows, "_shard", "_slot")
    assert gapless and sorted((str(r.doc_id), str(r.text)) for r in rows) == sorted((str(d), str(t)) for d, t in texts)
    assert max(counts.values()) - min(counts.values()) <= 1 and out.columns == ["doc_id", "text", "bucket", "_size", "_crc32", "_shard", "_slot"]
    again = op.shard_documents(df.repartition(5), 7, shared_path(spark, "t"), bucket_bytes=5000).collect()
    key = lambda r: (r._shard, r._slot, str(r.doc_id), str(r.text))
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert [r.doc_id for r in sorted(rows, key=lambda r: (r._shard, r._slot))] != sorted([d for d, _ in texts], key=str)


def test_fewer_rows_than_shards_and_none(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert sorted(r._slot for r in op.shard_documents(df, 16, shared_path(spark, "t")).collect()) == [0, 0]
    assert op.shard_documents(df.limit(0), 16, shared_path(spark, "t")).count() == 0


def test_fisher_yates_is_a_seeded_permutation():
    a = op.fisher_yates(1000, 1)
    assert sorted(a) == list(range(1000)) and a == op.fisher_yates(1000, 1) != op.fisher_yates(1000, 2) and op.fisher_yates(0, 1) == []
    first = Counter(op.fisher_yates(4, s)[0] for s in range(4000))
    assert all(900 < n < 1100 for n in first.values())


def test_equal_rows_part(spark, monkeypatch):
    """A row that is a third of the table spreads over the buckets, with and without other columns that differ."""
    monkeypatch.setattr(op, "HOT_ROWS", 100)
    monkeypatch.setattr(op, "BUCKETS_EACH", 8)
    rows = [(1, "hot text", 0)] * 3000 + [(None, "hot too", i) for i in range(1500)] + [(i, f"own {i}", 0) for i in range(3000, 6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra int")
    out = op.shard_documents(df, 5, shared_path(spark, "t"), bucket_bytes=2000).collect()
    gapless, counts = slots_are_gapless(out, "_shard", "_slot")
    assert gapless and max(counts.values()) - min(counts.values()) <= 1
    assert Counter((r.doc_id, r.text, r.extra) for r in out) == Counter(rows)
    # hot rows are in every shard about as often as elsewhere
    for text in ("hot text", "hot too"):
        share = Counter(r._shard for r in out if r.text == text)
        assert set(share) == set(range(5)) and max(share.values()) < 1.25 * min(share.values())
    again = op.shard_documents(df.repartition(7), 5, shared_path(spark, "t"), bucket_bytes=2000).collect()
    key = lambda r: (r._shard, r._slot, str(r.doc_id), r.text, r.extra)
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_columns_of_any_type(spark):
    df = spark.createDataFrame([(i % 3, "t", {"a": i}, [i]) for i in range(50)], "doc_id long, text string, m map<string,int>, `a.b` array<int>")
    out = op.shard_documents(df, 4, shared_path(spark, "t"), bucket_bytes=20)
    assert sorted(r["a.b"][0] for r in out.collect()) == list(range(50))
