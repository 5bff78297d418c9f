from chronolode.sources import store


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_changes_of_tables(spark):
    t = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (None, "n", 7)], "k int, s string, n int")
    new = spark.createDataFrame([(2, "B", 1), (3, "c", 2), (3, "c", 2)], "k int, s string, n int")
    assert rows(store.append_new(t, new, "k")) == [(1, "a", 5), (2, "b", 6), (3, "c", 2), (None, "n", 7)]
    assert rows(store.upsert_replace(t, new.dropDuplicates(), "k")) == [(1, "a", 5), (2, "B", 1), (3, "c", 2), (None, "n", 7)]
    assert rows(store.upsert_add(t, new, ["k"], ["n"])) == [(1, 5), (2, 7), (3, 4), (None, 7)]
    assert rows(store.latest(new, ["k"], "n")) == [(2, "B", 1), (3, "c", 2)]
    assert rows(store.delete_keys(t, new.select("k"))) == [(1, "a", 5), (None, "n", 7)]
    assert rows(store.update_key(t, "s", spark.createDataFrame([("a", "z")], "old string, new string"))) == [(1, "z", 5), (2, "b", 6), (None, "n", 7)]


def test_lookup_of_few_and_many(spark):
    t = spark.range(1000).toDF("k")
    assert store.lookup(t, "k", [3, 3, 5000]).count() == 1 and store.lookup(t, "k", range(0, 2000, 2)).count() == 500 and store.lookup(t, "k", []).count() == 0


def test_versions(spark, tmp_path):
    at, schema = str(tmp_path / "t"), "k int, s string"
    open_ = lambda: store.VersionedTable(spark, at, schema)
    t = open_()
    assert t.read().count() == 0
    one = spark.createDataFrame([(1, "a")], schema)
    old = t.append(one)
    assert t.append_new(one, "k").count() == 1 and open_().read().count() == 1 and old.count() == 1
    assert open_().append(one).count() == 2 and open_().upsert(one, "k").count() == 1
    assert open_().clear().count() == 0 and open_().read().count() == 0 and rows(open_().append(one)) == [(1, "a")]


def test_appends_write_their_rows_alone_and_old_versions_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MOST_PARTS", 4)
    t = store.VersionedTable(spark, str(tmp_path / "t"), "k int")
    for k in range(7):
        t.append(spark.createDataFrame([(k,)], "k int"))
        assert len(t.log.content["parts"]) == (k + 1 if k < 4 else k - 3)
    assert rows(t.read()) == [(k,) for k in range(7)]
    folders = {p.name for p in (tmp_path / "t").iterdir()} - {"_versions"}
    assert set(t.log.content["parts"]) <= folders and len(folders) <= 4 and len(list((tmp_path / "t" / "_versions").glob("*.json"))) == 2


def test_an_unfinished_write_changes_nothing(spark, tmp_path):
    t = store.VersionedTable(spark, str(tmp_path / "t"), "k int")
    t.append(spark.createDataFrame([(1,)], "k int"))
    bad = spark.range(3).selectExpr("cast(raise_error('x') as int) AS k")
    for change in (t.append, t.replace):
        try:
            change(bad)
            raise AssertionError
        except Exception as e:
            assert "x" in str(e)
    assert rows(store.VersionedTable(spark, str(tmp_path / "t"), "k int").read()) == [(1,)]
    # of two writers from one version the slower one fails
    a, b = (store.VersionedTable(spark, str(tmp_path / "t"), "k int") for _ in range(2))
    a.append(spark.createDataFrame([(2,)], "k int"))
    try:
        b.append(spark.createDataFrame([(3,)], "k int"))
        raise AssertionError
    except RuntimeError as e:
        assert "another writer" in str(e)
    assert rows(store.VersionedTable(spark, str(tmp_path / "t"), "k int").read()) == [(1,), (2,)]
