import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chronolode.llm import packing as op

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "Straße ÉTÉ été İstanbul ﬁn K don't it's WE'LL l'été naïve123 a_b (x) \t\x0b　日本 ½ Ǆ", "", "  ", "a\n\n b", "É́ x́.", "word,word. w!? 12,5 a-b ­İ",
    "σΣ ΣΑΣ ͅ x\x1cy\u0085z", "\0a ퟿ 🙂🙂 ''' 's 'S '", "ß ẞ ÿ Ÿ µ ª º", "a<|endoftext|>b <|startoftext|>. <|ENDOFTEXT|>",
]


def test_chunks_equal_the_whole_tokenizer(monkeypatch):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("aB éÉ,.'1 \n_ß") for _ in range(rng.randrange(60))) for _ in range(3000)]
    whole = Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)
    for limit in (10**6, 50):
        monkeypatch.setattr(op, "TABLE", limit)
        tokenizer = op.text_tokenizer(PATH)
        assert isinstance(tokenizer, op.ChunkTokenizer)
        got = [x for at in range(0, len(texts), 100) for x in tokenizer.ids(texts[at : at + 100])]
        assert got == [np.array(e.ids, "<u4").tobytes() for e in whole]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_other_tokenizers_encode_whole_texts(spark, name):
    path = public_tokenizers.path(name)
    texts = [*ODD, "Two  blanks,\n\nand don't join ' s"]
    want = [[*e.ids, 1] for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    rows = op.packed_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    assert isinstance(op.text_tokenizer(path), op.WholeTokenizer) and {r.doc_id: r.doc_tokens for r in rows} == {i: len(w) for i, w in enumerate(want)}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())


def test_whole_table(spark):
    """Every id of every document, as the tokenizer gives it, in one piece; sequences full or powers of two."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    ids = {r.doc_id: [*e.ids, 1] for r, e in zip(docs, Tokenizer.from_file(PATH).encode_batch([r.text or "" for r in docs], add_special_tokens=False))}
    rows = op.op7_packing(spark, "/root/testdata/sf0.01").collect()
    pieces, sequences = {}, {}
    for r in rows:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert (len(part), zlib.crc32(part.tobytes()), len(ids[r.doc_id])) == (r.length, r.ids_crc32, r.doc_tokens)
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    ends = lambda spans: [at + n for at, n in sorted(spans)]
    assert all([at for at, _ in sorted(p)] == [0, *ends(p)[:-1]] and ends(p)[-1] == len(ids[d]) for d, p in pieces.items()) and set(pieces) == set(ids)
    assert all([at for at, _ in sorted(s)] == [0, *ends(s)[:-1]] and (ends(s)[-1] == 2048 or ends(s)[-1].bit_count() == 1) for s in sequences.values())


def test_groups_are_bounded():
    assert list(op.groups(["a" * 9, "b", "c" * 3, "d" * 3, "e", "f"], 2, 5)) == [["a" * 9], ["b", "c" * 3], ["d" * 3, "e"], ["f"]] and list(op.groups([])) == []


def check(lengths, sequences, window):
    pieces = {}
    for s in sequences:
        total = sum(n for _, _, n in s)
        assert total == window or total & (total - 1) == 0 and total < window
        for item, start, n in s:
            assert n > 0
            pieces.setdefault(item, []).append((start, n))
    for item, n in enumerate(lengths):
        at = 0
        for start, m in sorted(pieces.pop(item, [])):
            assert start == at
            at += m
        assert at == n
    assert not pieces


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=150))
def test_every_id_in_one_piece(lengths):
    check(lengths, op.pack_lengths(lengths), op.WINDOW)


def test_hot_length():
    lengths = [1536] * 4000 + [10] * 50 + [512] * 1000
    got = op.pack_lengths(lengths)
    check(lengths, got, op.WINDOW)
    assert sum(sorted(n for _, _, n in s) == [512, 1536] for s in got) > 800


def test_nnls_is_optimal():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, b = rng.random((12, 20)), rng.random(12) * 5
        x = op.nnls(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and (slope < 1e-6).all() and (np.abs(slope[x > 1e-9]) < 1e-6).all()


def test_nulls_empties_repeats(spark):
    texts = [(1, None), (2, ""), (None, "hello"), (3, "hello world " * 3000), (3, "hello world " * 3000)]
    df = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, ids string")
    rows = op.packed_pieces(df).collect()
    ids = {t: np.array([*Tokenizer.from_file(PATH).encode(t or "", add_special_tokens=False).ids, 1], "<u4") for _, t in texts}
    want = sum(len(ids[t]) for _, t in texts)
    assert sum(r.length for r in rows) == want
    for r in rows:
        part = ids[dict(texts)[r.doc_id]][r.start : r.start + r.length]
        assert (zlib.crc32(part.tobytes()), len(part)) == (r.ids_crc32, r.length)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 2048 or at & (at - 1) == 0
    assert op.packed_pieces(df.limit(0)).count() == 0
