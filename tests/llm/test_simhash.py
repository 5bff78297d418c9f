import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from chronolode.llm import simhash as op
from chronolode.llm.tables import read

SF = "/root/testdata/sf0.01"


def slow_fingerprint(text, size=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def groups(prints, linked):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if linked(prints[i], prints[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_equals_brute_force(spark):
    rows = sorted(map(tuple, read(spark, SF, "documents", "doc_id", "text").collect()))
    prints = [slow_fingerprint(t) for _, t in rows]
    labels = groups(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    got = sorted(map(tuple, op.op9_simhash_near_dedup(spark, SF).collect()))
    assert got == [(d, f"{f:016x}", rows[k][0]) for (d, _), f, k in zip(rows, prints, labels)]


def test_links_are_lost_nowhere(monkeypatch):
    rng = random.Random(3)
    for words, radius in ((1, 3), (4, 20)):
        bits = 64 * words
        base = [rng.getrandbits(bits) for _ in range(6)]
        values = [rng.choice(base) ^ sum(1 << b for b in rng.sample(range(bits), rng.randrange(radius + 2))) for _ in range(300)] + [rng.getrandbits(bits) for _ in range(100)]
        keys = np.sort(np.array([rng.randrange(4) for _ in values]))
        rows = np.array([[v >> 64 * w & (2**64 - 1) for w in range(words)] for v in values], np.uint64).view(np.int64)
        a, b = op.links_within(keys, rows, radius)
        assert all(keys[i] == keys[j] and (values[i] ^ values[j]).bit_count() <= radius for i, j in zip(a, b))
        want = groups(list(zip(keys, values)), lambda x, y: x[0] == y[0] and (x[1] ^ y[1]).bit_count() <= radius)
        linked = {frozenset(p) for p in zip(a.tolist(), b.tolist())}
        have = groups(list(range(len(values))), lambda i, j: frozenset((i, j)) in linked)
        assert have == want and len(a) == len(values) - len(set(want))


def test_large_bucket_is_dealt_in_chunks(spark):
    rng = random.Random(4)
    rows = [(7, i, rng.getrandbits(20)) for i in range(300)] + [(8, 900, 1), (9, 901, 1)]
    df = spark.createDataFrame(rows, "key long, node long, fp0 long")
    links = op.bucket_links(df, 1, (1, 2), chunk=40).collect()
    want = groups([r[2] for r in rows[:300]], lambda a, b: (a ^ b).bit_count() <= 2)
    pairs = {frozenset((r.src, r.dst)) for r in links}
    assert groups(list(range(300)), lambda i, j: frozenset((i, j)) in pairs) == want and all(r.src < 900 for r in links)


def test_nulls_empties_repeats(spark):
    rows = [(3, None), (5, ""), (5, ""), (4, " \n"), (None, "a b c"), (1, "a b c"), (2, "A B C"), (9, "z " * 3000), (8, "z " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp0": F.lit("clash"), "node": F.lit(1)})
    got = sorted(((r.doc_id, r.component_id) for r in op.simhash_components(df).collect()), key=str)
    assert got == sorted([(3, 3), (5, 3), (5, 3), (4, 3), (None, 1), (1, 1), (2, 1), (9, 8), (8, 8)], key=str)
    assert op.simhash_components(df.limit(0)).count() == 0 and op.without_copies(df.limit(0)).count() == 0


def test_near_copies_stay_once(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, groups_ = [], {}
    for g in range(40):
        base = [word() for _ in range(300)]
        for k in range(3):
            text = list(base)
            for _ in range(k * 2):  # two or four of 300 words: similarity 0.87 or more
                text[rng.randrange(300)] = word()
            rows.append((g * 10 + k, " ".join(text)))
            groups_[g * 10 + k] = g * 10
    rows += [(1000 + i, " ".join(word() for _ in range(200))) for i in range(100)] + [(2000, rows[0][1]), (None, "kept"), (2001, None), (2002, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("keys", F.lit(0))
    kept = [r.doc_id for r in op.without_copies(df).collect()]
    clean = [d for d, _ in rows if d is None or 1000 <= d < 2000]
    assert set(clean) <= set(kept) and 2000 not in kept and 2001 in kept and 2002 not in kept
    assert sum(d in kept for d in groups_) <= 42 and all(g in kept for g in set(groups_.values()))
    assert op.without_copies(df).columns == df.columns


def test_star_of_near_copies_is_one_group(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(400)]
    rows = [(0, " ".join(base))]
    for k in range(1, 1001):  # six of 400 words: 0.86 to the original, about 0.75 to each other
        text = list(base)
        for at in rng.sample(range(10, 390), 6):
            text[at] = word()
        rows.append((k, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in op.without_copies(df).collect()] == [0]


def test_verified_links_equal_brute_force(spark):
    rng = random.Random(7)
    sets = [np.unique(np.array([rng.randrange(14) for _ in range(rng.randrange(12))], np.uint64)) for _ in range(150)]
    share = lambda x, y: len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y))
    want = groups(sets, share)
    a, b = op.verified_links(sets, 0.8)
    assert all(share(sets[i], sets[j]) for i, j in zip(a, b)) and len(a) == len(sets) - len(set(want))
    texts = [" ".join(f"w{x}" for x in s) for s in sets]
    near = spark.createDataFrame([(i, 0) for i in range(len(sets))], "node long, component long")
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, text string").withColumn("text", F.col("text").cast("binary"))
    for chunk in (1024, 20):
        linked = {frozenset(r) for r in op.alike(near, rows, 1, 0.8, chunk).collect()}
        assert groups(list(range(len(sets))), lambda i, j: frozenset((i, j)) in linked) == want


def test_repeated_passages_and_short_texts_are_near_copies(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for g in range(12):  # 0.95 or more of the distinct shingles in common, a line repeated in one of them
        base, line = [word() for _ in range(304)], [word() for _ in range(12)]
        rows += [(4 * g, " ".join(base)), (4 * g + 1, " ".join(base + line * (5, 10, 20, 50)[g % 4]))]
    for g in range(12, 300):  # 4 of 5 shingles, and 18 of 22
        n = (8, 22)[g % 2]
        base = [word() for _ in range(n + (1, 4)[g % 2])]
        rows += [(4 * g, " ".join(base)), (4 * g + 1, " ".join(base[:n]))]
    kept = {r.doc_id for r in op.without_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pairs = {d for d, _ in rows if d % 4 == 0}
    assert kept == pairs


def test_an_id_with_several_texts_has_the_links_of_all(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    a, b, c = ([word() for _ in range(200)] for _ in range(3))
    text = lambda t, *cut: " ".join(x for i, x in enumerate(t) if i not in cut)
    rows = [(5, text(a)), (5, text(b)), (5, text(b)), (7, text(a, 3)), (8, text(b, 9)), (9, text(c)), (6, text(b)), (10, text(c, 4))]
    got = {(r.doc_id, r.component_id) for r in op.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 5), (6, 5), (7, 5), (8, 5), (9, 9), (10, 9)}


def test_pairs_just_at_the_similarity_are_linked(spark):
    """Pairs of 20 to 300 shingles that share 0.8 of them, or the least above: none is lost to blocks or radius."""
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    rows = []
    for g in range(1500):
        both = rng.randrange(20, 300)
        own = both // 4  # shingles of one text only, all at its end or half on each side
        shared = [word() for _ in range(both + 4)]
        left = own // 2 if g % 2 else 0
        rows += [(2 * g, " ".join(shared + [word() for _ in range(left)])), (2 * g + 1, " ".join([word() for _ in range(own - left)] + shared))]
    kept = [r.doc_id for r in op.without_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept) == list(range(0, 3000, 2))
