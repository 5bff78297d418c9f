import zlib

import numpy as np
from pyspark.sql import functions as F

from chronolode.llm import quality as op
from chronolode.llm.tables import read

SF = "/root/testdata/sf0.1"


def test_held_out_labels(spark):
    got = {r.doc_id: r for r in op.op10_quality_classifier(spark, SF).collect()}
    labels = [(got[r.doc_id], r.quality) for r in read(spark, SF, "labels", "doc_id", "quality").collect() if got[r.doc_id].held_out]
    assert np.mean([g.predicted == y for g, y in labels]) > 0.99
    assert np.mean([g.predicted for g, y in labels if y]) > 0.995 and len(got) == 10_000
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_scores_equal_the_densities():
    rng = np.random.default_rng(1)
    d = len(op.STATISTICS)
    x = rng.normal(size=(400, d)) + np.r_[4.0, np.zeros(d - 1)]
    y = rng.random(400) < 0.3
    x[y, 1] += 2
    center = x.mean(axis=0)
    z = op.drawn(x, center)
    model = op.fit([float((~y).sum()), float(y.sum())], [z[~y].sum(0), z[y].sum(0)], [z[~y].T @ z[~y], z[y].T @ z[y]], center)
    log = []
    covs = [np.cov(z[c].T, bias=True) for c in (~y, y)]
    pooled = sum(c * n for c, n in zip(covs, ((~y).sum(), y.sum()))) / 400
    for c, cov in zip((~y, y), covs):
        s = (1 - op.POOLED) * cov + op.POOLED * pooled
        s = (1 - op.DIAGONAL) * s + op.DIAGONAL * np.diag(np.diag(s)) + op.RIDGE * np.eye(d)
        diff = z - z[c].mean(0)
        log.append(np.log(c.mean()) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(s), diff))
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(log[0] - log[1])))


def test_statistics_of_odd_texts():
    for text in (b"", b" \n ", b"a", b"***", b"a " * 100_000, "é".encode() * 50_000, b"\xff\x00"):
        s = op.statistics(text)
        assert len(s) == len(op.STATISTICS) and np.isfinite(s).all()


def test_few_labels_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "k"), (2, None, "k"), (3, "", "k"), (3, "", "k"), (None, "x y z", "k")], "doc_id long, text string, x string")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert op.fit_labelled(op.document_statistics(docs), none).base == 0.5
    kept = op.accepted(docs, none)
    assert kept.columns == docs.columns and kept.count() == 5 and op.accepted(docs.limit(0), none).count() == 0
    one = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "doc_id long, quality int")
    assert op.fit_labelled(op.document_statistics(docs), one).base == 1.0
    trained = [r.doc_id for r in docs.where(op.training(F.col("doc_id"))).collect()]
    import zlib

    assert trained == [i for i in (1, 2, 3, 3) if zlib.crc32(str(i).encode()) % 3 != 1]


def test_the_query_equals_brute_force(spark):
    """Class sums by numpy over the labelled training rows, then the same densities for every row."""
    small = "/root/testdata/sf0.01"
    texts = {r.doc_id: (r.text or "").encode() for r in read(spark, small, "documents", "doc_id", "text").collect()}
    labels = {r.doc_id: r.quality for r in read(spark, small, "labels", "doc_id", "quality").collect()}
    x = {d: np.array(op.statistics(t)) for d, t in texts.items()}
    taught = [d for d in labels if zlib.crc32(str(d).encode()) % 3 != 1]
    center = np.mean([x[d] for d in taught], axis=0)
    drawn = {y: op.drawn(np.array([x[d] for d in taught if labels[d] == y]), center) for y in (0, 1)}
    model = op.fit([float(len(drawn[y])) for y in (0, 1)], [drawn[y].sum(0) for y in (0, 1)], [drawn[y].T @ drawn[y] for y in (0, 1)], center)
    want = dict(zip(x, model.scores(np.array(list(x.values())))))
    got = {r.doc_id: r for r in op.op10_quality_classifier(spark, small).collect()}
    assert got.keys() == want.keys() and all(abs(got[d].score - want[d]) < 1e-6 and got[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d in want)


def test_accepted_with_many_labels_is_the_same(spark, monkeypatch):
    docs, labels = (read(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    few = sorted(r.doc_id for r in op.accepted(docs, labels).collect())
    monkeypatch.setattr(op, "SENT_LABELS", 0)
    assert sorted(r.doc_id for r in op.accepted(docs, labels).collect()) == few and 0 < len(few) < 1000
