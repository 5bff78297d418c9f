import numpy as np
import pytest

from chronolode.llm import toxicity as op
from chronolode.llm.tables import read

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    return op.language_model(op.character_counts(read(spark, SF, "documents", "text")))


def test_held_out_labels(spark):
    got = {r.doc_id: r for r in op.op3_toxicity(spark, SF).collect()}
    labels = [(got[r.doc_id], r.toxic) for r in read(spark, SF, "labels", "doc_id", "toxic").collect() if got[r.doc_id].held_out]
    hit = sum(g.predicted == 1 and y == 1 for g, y in labels)
    assert hit / sum(y for _, y in labels) > 0.85 and hit / sum(g.predicted for g, _ in labels) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values()) and len(got) == 10_000


def test_counts_cover_whole_texts(spark):
    df = spark.createDataFrame([("ab",), (None,), ("",), ("b" * 3000,)], "text string")
    n = op.character_counts(df)
    assert n[0, 0, 1] == n[0, 1, 2] == n[1, 2, 0] == 1 and n[2, 2, 2] == 2998 and op.character_counts(df.limit(0)).sum() == 0


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(1)
    model = op.language_model(rng.integers(0, 50, (28, 28, 28)).astype(float))

    def score(text, channel):
        a = b = 0
        for c in text:
            z = ord(c) - 96 if "a" <= c <= "z" else 27
            channel += model[a][b][z]
            a, b = b, z
        return channel + model[a][b][0]

    for token in ("1d10t", "st00pid", "a11b", "sc*m", "heeeello", "$$!x", "b4d"):
        paths = [("", 0.0)]
        for options in op.lattice(token):
            paths = [(t + x, s + c) for t, s in paths for x, c in options]
        assert op.decode(token, model.tolist())[0] == max(paths, key=lambda p: score(*p))[0]


@pytest.mark.parametrize("word, disguises", [
    ("idiot", ["1d10t", "id1ot", "idiooot", "i d i o t", "i.d.i.o.t", "ID!OT"]), ("moron", ["m0r0n", "m-o-r-o-n", "moroooon", "M O R O N"]),
    ("loser", ["l0ser", "lo$er", "los3r"]), ("trash", ["tr4sh", "tra$h", "t r a s h"]), ("worthless", ["w0rthless", "worthle55"]),
])
def test_disguises_are_restored(model, word, disguises):
    restorer = op.Restorer(model)
    for d in disguises:
        assert word in restorer.words(f"The of {d} was there."), d


def test_plain_text_is_left_alone(model):
    text = "Plain words, 3 numbers 12.5 and a.b. The end!"
    assert op.Restorer(model).words(text) >= set(text.lower().split()) and op.Restorer(model).words("the thing of") == {"the", "thing", "of"}


def test_without_labels_nulls_and_ties(spark, tmp_path):
    docs = [(1, "a"), (2, None), (3, ""), (3, ""), (None, "i d i o t"), (4, "x" * 200_000), (5, "1 1 1 " * 20_000)]
    spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, y string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = op.op3_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(docs) and all(r.score < 1e-9 and r.predicted == 0 for r in got)
    spark.createDataFrame([(i, i % 2) for i in range(1, 6)], "doc_id long, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    assert op.op3_toxicity(spark, str(tmp_path)).count() == len(docs)


@pytest.mark.parametrize("word, disguises", [("idiot", ["id--iot", "id**iot", "iDdDiot", "idiiot"]), ("moron", ["m0ron", "morron"]), ("stupid", ["sTtTupid", "stuupid"]), ("loser", ["los€r", "looser"])])
def test_disguises_need_nothing_else_in_the_text(model, word, disguises):
    for d in disguises:
        assert word in op.Restorer(model).words(f"the of {d} was there"), d


def test_long_tokens_are_read_in_one_go(model):
    assert op.Restorer(model).words("abbc" * 50_000)


def test_capped_labels_keep_the_odds(spark, tmp_path, monkeypatch):
    docs = [(i, "plain words of the day" if i % 11 else f"vile words of the day {i}") for i in range(1, 2200)] + [(5000, "of the day")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    # labels say nothing about the words, so the score of any text is the share of label 1
    spark.createDataFrame([(d, int(d % 10 == 0)) for d, _ in docs[:-1]], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    score = lambda: next(r.score for r in op.op3_toxicity(spark, str(tmp_path)).collect() if r.doc_id == 5000)
    assert abs(score() - 0.1) < 0.03
    monkeypatch.setattr(op, "MAX_CLEAN", 300)
    assert abs(score() - 0.1) < 0.03


def test_a_repeated_id_is_learned_once(spark, tmp_path):
    """A labelled id that a third of the rows share is one training row, and every row is scored."""
    texts = {i: ("you idiot moron" if i % 3 == 0 else "a fine day") + f" word{i % 7}" for i in range(60)}
    rows = [(i, t) for i, t in texts.items()] + [(5, "a fine day too")] * 40 + [(None, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = op.op3_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == 101 and all(r.predicted == int(r.doc_id is not None and r.doc_id % 3 == 0) for r in got)
