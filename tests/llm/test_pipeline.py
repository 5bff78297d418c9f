import random
import re

import pytest

import corpus_pipeline as pipeline
from chronolode.llm import line_dedup, quality, simhash
from chronolode.llm.tables import read

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What goes into each stage and comes out."""
    docs, out = read(spark, SF, "documents"), [("documents", read(spark, SF, "documents").collect())]
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, docs.collect()))
    return out


def test_stages_and_columns(stages):
    assert [n for n, _ in stages] == ["documents", "quality", "line_dedup", "near_copies", "benchmark", "packing"]
    for (_, rows) in stages[:5]:
        assert rows[0].__fields__ == ["doc_id", "text", "lang", "source", "n_chars"] and len({r.doc_id for r in rows}) == len(rows)


def test_quality_keeps_clean_documents(spark, stages):
    kept = {r.doc_id for r in stages[1][1]}
    labels = {r.doc_id: r.quality for r in read(spark, SF, "labels", "doc_id", "quality").collect()}
    assert all((d in kept) == (y == 1) for d, y in labels.items())


def test_lines_equal_brute_force(stages):
    before, after = {r.doc_id: r.text for r in stages[1][1]}, {r.doc_id: r for r in stages[2][1]}
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(line_dedup.STRIPPED))
    holders = {}
    for d, t in before.items():
        for k in set(map(key, t.split("\n"))):
            if len(k) >= 40:
                holders.setdefault(k, set()).add(d)
    keeper = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    for d, t in before.items():
        want = "\n".join(x for x in t.split("\n") if keeper.get(key(x), d) == d)
        assert (after[d].text, after[d].n_chars) == (want, len(want))


def test_near_copies_against_all_pairs(stages):
    texts, kept = {r.doc_id: r.text.encode() for r in stages[2][1]}, {r.doc_id for r in stages[3][1]}
    sets = {d: set(simhash.shingle_hashes(t, 5).tolist()) for d, t in texts.items()}
    index = {}
    for d, s in sets.items():
        for h in s:
            index.setdefault(h, []).append(d)
    links = {}
    for d, s in sets.items():
        shared = {}
        for h in s:
            for e in index[h]:
                if e < d:
                    shared[e] = shared.get(e, 0) + 1
        for e, n in shared.items():
            if n >= 0.8 * (len(s) + len(sets[e]) - n):
                links.setdefault(d, set()).add(e)
                links.setdefault(e, set()).add(d)
    empty = [d for d in texts if not sets[d]]
    lost = [d for d in texts if d not in kept]
    assert all(d in links or d in empty for d in lost), "a document without a near copy went"
    # every group, followed through all its links, is down to its smallest id
    seen, whole, groups = set(), 0, 0
    for d in sorted(links):
        if d not in seen:
            group, todo = {d}, [d]
            while todo:
                for e in links[todo.pop()] - group:
                    group.add(e)
                    todo.append(e)
            seen |= group
            groups += 1
            whole += {e for e in group if e in kept} == {d}
    assert whole == groups > 0


def test_benchmark_equals_brute_force(spark, stages):
    """Shingles as sets of word tuples, without signatures or codes."""
    cut = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"\w+", t.lower())] for i in range(len(w) - 4)}
    items = [cut(r.text) for r in read(spark, SF, "benchmark", "item_id", "text").collect()]
    holds = lambda t: any(len(i & own) >= 0.8 * len(i) for own in [cut(t)] for i in items)
    kept = {r.doc_id for r in stages[4][1]}
    assert kept == {r.doc_id for r in stages[3][1] if not holds(r.text)} and len(kept) < len(stages[3][1]) and all(items)


def test_packing_holds_all_that_is_left(stages):
    assert {r.doc_id for r in stages[5][1]} == {r.doc_id for r in stages[4][1]}
    for d in random.Random(1).sample(sorted({r.doc_id for r in stages[5][1]}), 50):
        parts = sorted((r.start, r.length, r.doc_tokens) for r in stages[5][1] if r.doc_id == d)
        assert sum(p[1] for p in parts) == parts[0][2] and parts[0][0] == 0


def test_run_gives_the_last_stage(spark, stages):
    assert pipeline.run(spark, SF).count() == len(stages[5][1]) and quality.STATISTICS
