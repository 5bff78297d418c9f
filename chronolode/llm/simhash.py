"""SimHash near-duplicate detection with bit-sliced comparison.

Fingerprints are made whole-text at a time and deduplicated, so exact copies cost one comparison row.
Rows that could link meet in buckets; inside a bucket the fingerprints are transposed to bit planes and
each shift of the planes against themselves compares every row with the row so many places on, 64 rows a
machine word. Differing bits are added by carry-save adders into bitwise counters, and a shift is left
as soon as every lane has passed the radius. Lanes whose rows already share a group count as passed, so a
dense group of copies costs little. A bucket too large for one task is dealt into chunks, and every pair of
chunks is a task of its own; only links that join two groups leave a task, never all pairs.

Defined results: null or white-space text has fingerprint zero, linked like any other; a null doc_id
takes part in grouping but never names a group unless all its members are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolode.llm.tables import read
from chronolode.plans.graph import connected_components
from chronolode.session import cut_lineage

#: Near-copy grouping: 64-bit words of a fingerprint, the radius, blocking keys, and the exact similarity of a link. One radius does: nearer
#: ones taken before it leave the same components, and each of them costs a pass over all shifts.
WORDS, RADII, BANDS, ROWS, SIMILARITY = 4, (66,), 20, 3, 0.8
#: Texts of fewer distinct shingles have no telling fingerprint, so the radius does not apply to them.
SHORT = 20
CHUNK = 1024  # rows of a bucket that one side of a task holds, on average


def shingle_hashes(text: bytes, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each ``size``-word shingle of the A-Z lower-cased text, repeats included.

    Words are separated by ASCII white space. Fewer words than ``size``: the whole sequence; none: empty.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-size].tolist()]
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())], np.uint64)


def majority(hashes: np.ndarray) -> np.ndarray:
    """Bits set in over half of the 64-bit hashes, least significant first."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return 2 * total > len(hashes)


def fingerprint(text: bytes, size: int = 3, words: int = 1) -> np.ndarray:
    """``words`` 64-bit words of SimHash. Words after the first use multiplicative rehashes of the shingle hashes."""
    hashes = shingle_hashes(text, size)
    out = [majority(hashes)]
    for k in range(1, words):
        out.append(majority(rehash(hashes, k)))
    return np.packbits(np.concatenate(out), bitorder="little").view(np.int64)


def rehash(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th of a family of mixings of 64-bit hashes (a splitmix64 finaliser after adding k odd constants)."""
    with np.errstate(over="ignore"):
        z = hashes + np.uint64((0x9E3779B97F4A7C15 * k) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fingerprints(docs: DataFrame, size: int = 3, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp0..fp{words-1}: the fingerprint words as signed longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            made = np.zeros((len(batch), words), np.int64)
            for i, t in enumerate(texts):
                made[i] = fingerprint(t.as_py() or b"", size, words)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(made[:, k]) for k in range(words))], names=names)

    names = ["doc_id", *(f"fp{k}" for k in range(words))]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def shifted(planes: np.ndarray, d: int) -> np.ndarray:
    """Bit planes (rows of little-endian lane bits in uint64) moved down by ``d`` lanes; the tail is zero."""
    skip, bits = divmod(d, 64)
    out = np.zeros_like(planes)
    if skip < planes.shape[1]:
        out[:, : planes.shape[1] - skip] = planes[:, skip:]
    if bits:
        high = out << np.uint64(64 - bits)
        out >>= np.uint64(bits)
        out[:, :-1] |= high[:, 1:]
    return out


def over_radius(planes: np.ndarray, moved: np.ndarray, radius: int, passed: np.ndarray) -> np.ndarray | None:
    """Lanes that differ in more than ``radius`` bits or are in ``passed``; None once that is every lane.

    Two planes at a time go through a 3:2 carry-save adder into the ones; carries ripple upwards, and a carry
    out of the last counter marks its lane as passed for good.
    """
    width = max(1, (radius + 1).bit_length())
    counters = [np.zeros(planes.shape[1], np.uint64) for _ in range(width)]
    full = ~np.uint64(0)

    def carry_up(carry: np.ndarray, at: int) -> None:
        for k in range(at, width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        np.bitwise_or(passed, carry, out=passed)

    for at in range(0, len(planes), 8):
        diff = planes[at : at + 8] ^ moved[at : at + 8]
        for a, b in zip(diff[::2], diff[1::2]):
            ones = counters[0]
            half = a ^ b
            counters[0] = ones ^ half
            carry_up((a & b) | (ones & half), 1)
        # a lane is over when its counters exceed the radius, compared from the highest bit down
        over, same = np.zeros_like(passed), np.full_like(passed, full)
        for k in range(width - 1, -1, -1):
            if radius >> k & 1:
                same &= counters[k]
            else:
                over |= same & counters[k]
                same &= ~counters[k]
        passed |= over
        if (passed == full).all():
            return None
    return passed


def links_within(groups: np.ndarray, prints: np.ndarray, *radii: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs that join the linked rows of each run of equal ``groups`` (a spanning set, not all pairs).

    ``prints``: rows by 64-bit words. Of several ascending ``radii`` each joins what the ones before left apart, so nearer
    pairs are taken first.
    """
    label, left, right = np.arange(len(groups)), [], []
    for radius in radii:
        label = _join_within(groups, prints, radius, label, left, right)
    return np.array(left, np.int64), np.array(right, np.int64)


def _join_within(groups: np.ndarray, prints: np.ndarray, radius: int, label: np.ndarray, left: list[int], right: list[int]) -> np.ndarray:
    """Adds the pairs of one radius to ``left`` and ``right`` and returns the labels they leave."""
    n = len(groups)
    live = np.arange(n)
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.diff(np.r_[starts, n])
    longest = np.repeat(sizes, sizes)
    d, packed_for = 1, -1
    while True:
        if d & (d - 1) == 0:  # now and then the rows of groups that are done go
            live = live[longest[live] > d]
            if not len(live):
                break
            lanes = -(-len(live) // 64) * 64
            bits = np.unpackbits(np.ascontiguousarray(prints[live]).view(np.uint8), axis=1, bitorder="little")
            planes = np.zeros((bits.shape[1], lanes), np.uint8)
            planes[:, : len(live)] = bits.T
            planes = np.packbits(planes, axis=1, bitorder="little").view(np.uint64)
            packed_for = len(live)
        if d >= packed_for:
            break
        a, b = live[:-d], live[d:]
        want = (groups[a] == groups[b]) & (label[a] != label[b])
        if want.any():
            mask = np.zeros(planes.shape[1] * 64, np.uint8)
            mask[: len(want)] = want
            passed = ~np.packbits(mask, bitorder="little").view(np.uint64)
            passed = over_radius(planes, shifted(planes, d), radius, passed)
            if passed is not None:
                hit = np.flatnonzero(np.unpackbits((~passed).view(np.uint8), bitorder="little")[: len(want)])
                for i in hit.tolist():
                    x, y = int(a[i]), int(b[i])
                    while label[x] != x:
                        x = int(label[x])
                    while label[y] != y:
                        y = int(label[y])
                    if x != y:
                        label[max(x, y)] = min(x, y)
                        left.append(int(a[i]))
                        right.append(int(b[i]))
                if len(hit):
                    while (label[label] != label).any():
                        label = label[label]
        d += 1
    return label


def stars(label: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows grouped by ``label``: each group's least node, as row by row, and the rows of other nodes."""
    order = np.lexsort((node, label))
    first = order[np.r_[True, label[order][1:] != label[order][:-1]]] if len(order) else order
    least = np.empty(len(label), node.dtype)
    least[order] = np.repeat(node[first], np.diff(np.r_[np.searchsorted(label[order], label[first]), len(order)]))
    return least, np.flatnonzero(least != node)


def task_links(group: np.ndarray, part: np.ndarray, node: np.ndarray, prints: np.ndarray, radii: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """src, dst: what joins the linked rows of each group of one or two parts.

    Rows of one part are joined first. A group of one part gives its stars, each row with the least node of its component; a group of two gives only what
    joins such components across, by their least nodes, for each part's stars come from its own group. So a dense bucket gives about
    as many links as it has rows, however many pairs of parts it is dealt into.
    """
    label, left, right = np.arange(len(group)), [], []
    within = np.cumsum(np.r_[True, (group[1:] != group[:-1]) | (part[1:] != part[:-1])])
    for radius in radii:
        label = _join_within(within, prints, radius, label, left, right)
    least, others = stars(label, node)
    ends = np.flatnonzero(np.r_[group[1:] != group[:-1], True])
    starts = np.r_[0, ends[:-1] + 1]
    both = np.repeat(part[starts] != part[ends], ends - starts + 1)
    src, dst = [least[others[~both[others]]]], [node[others[~both[others]]]]
    if both.any():
        at = np.flatnonzero(both)
        left, right = [], []
        known = np.unique(label[at], return_inverse=True)[1].ravel()  # labels as rows of the part looked at: each group's first row
        first = np.full(known.max() + 1, len(at))
        np.minimum.at(first, known, np.arange(len(at)))
        across = first[known]
        for radius in radii:
            across = _join_within(group[at], prints[at], radius, across, left, right)
        src.append(least[at[np.array(left, np.int64)]])
        dst.append(least[at[np.array(right, np.int64)]])
    return np.concatenate(src), np.concatenate(dst)


def bucket_links(buckets: DataFrame, words: int, radii: tuple[int, ...], chunk: int = CHUNK, n_rows: int | None = None) -> DataFrame:
    """src, dst: what joins the rows of a bucket that are linked within the last of ``radii``; the components are those of the links.

    ``buckets``: key (long), node (long), fp0.. , ``n_rows`` of them if that is known. Buckets of one row drop out. A bucket of over ``chunk``
    rows is dealt by hash into parts, and each unordered pair of parts becomes a group for one task.
    """
    prints = [f"fp{k}" for k in range(words)]
    # written out, so that the join has an exchange of its own on both sides and a hot bucket can be split
    counts = cut_lineage(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), n_rows, 250_000)
    parts = F.ceil(F.col("n") / chunk).cast("int")
    rows = buckets.join(counts, "key").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    pair = F.when(F.col("parts") == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.least(x, F.col("part")).cast("long") * F.col("parts") + F.greatest(x, F.col("part")))
    )
    dealt = rows.select("key", F.explode(pair).alias("pair"), "part", "node", *prints)
    width = max(1, int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.repartition(width, "key", "pair").sortWithinPartitions("key", "pair", "part", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve(table: pa.Table) -> pa.RecordBatch:
            key, pair, part = (table.column(c).to_numpy() for c in ("key", "pair", "part"))
            node = table.column("node").to_numpy()
            new = np.r_[True, (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])]
            fps = np.stack([table.column(c).to_numpy() for c in prints], axis=1)
            src, dst = task_links(np.cumsum(new), part, node, fps, radii)
            return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            key, pair = table.column("key").to_numpy(), table.column("pair").to_numpy()
            change = np.flatnonzero((key[1:] != key[:-1]) | (pair[1:] != pair[:-1]))
            if len(change):  # all but the last group are complete
                cut = int(change[-1]) + 1
                yield solve(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield solve(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "src long, dst long")


def band_buckets(prints: DataFrame) -> DataFrame:
    """key, node, fp0: 16 buckets a 64-bit fingerprint, such that any two within 3 bits share one.

    Of four 16-bit bands two such fingerprints agree on one; of the other 48 bits, cut in four, they agree on a
    12-bit part too. Bucket, band and part values make a 32-bit key, so buckets stay small as the corpus grows.
    """
    band = lambda b: f"(shiftrightunsigned(fp0, {16 * b}) & 65535)"
    keys = []
    for b in range(4):
        rest = [x for x in range(4) if x != b]
        wide = f"({band(rest[0])} | shiftleft({band(rest[1])}, 16) | shiftleft({band(rest[2])}, 32))"
        for s in range(4):
            keys.append(f"shiftleft(cast({b * 4 + s} as bigint), 28) | shiftleft({band(b)}, 12) | (shiftrightunsigned({wide}, {12 * s}) & 4095)")
    return prints.selectExpr(f"explode(array({', '.join(keys)})) AS key", "fp0 AS node", "fp0")


def simhash_components(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp0, component_id: groups of documents whose fingerprints link at 3 or fewer differing bits, exactly."""
    made = cut_lineage(fingerprints(docs, size, 1, id_col, text_col))
    n = made.count()
    distinct = cut_lineage(made.groupBy("fp0").agg(F.min("doc_id").alias("first_id")), n)
    groups = connected_components(bucket_links(band_buckets(distinct), 1, (3,), n_rows=16 * n))
    rooted = distinct.join(groups, distinct.fp0 == groups.node, "left").select("fp0", "first_id", F.coalesce("component", "fp0").alias("root"))
    least = cut_lineage(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), n)
    named = rooted.join(least, "root").select("fp0", "component_id")
    return made.join(named, "fp0").select("doc_id", "fp0", "component_id")


def blocking_keys(hashes: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """``bands`` keys, each of ``rows`` minima of the hashes under multiplications modulo 2^64.

    Texts of similarity J share a given key with probability J^rows: at 0.8, 20 keys of 3 miss one pair in a million.
    """
    if not len(hashes):
        return np.zeros(bands, np.int64)
    out = np.empty(bands * rows, np.uint64)
    odd = rehash(np.arange(1, bands * rows + 1, dtype=np.uint64), 1) | np.uint64(1)
    with np.errstate(over="ignore"):
        mixed = hashes ^ (hashes >> np.uint64(29))
        for k in range(bands * rows):
            out[k] = (mixed * odd[k]).min()
        keys = np.zeros(bands, np.uint64)
        for r in range(rows):
            keys = rehash(keys ^ out[r::rows], r + 1)
    return keys.view(np.int64)


def verified_links(sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Row pairs that span the groups of rows whose sets of numbers (sorted, distinct) share ``similarity``, exactly.

    Each row is compared with all rows that no group has reached yet, so a pair that is left out joins rows of one group and
    a pair that fails joins nothing.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel()
    ends = np.cumsum(sizes)
    row_of = np.repeat(np.arange(len(sets)), sizes)
    left, right, rest, rest_ids = [], [], np.arange(len(sets)), ids
    mark = np.zeros(int(ids.max(initial=-1)) + 1, bool)

    def leave(gone: np.ndarray) -> None:
        nonlocal rest, rest_ids
        stay = np.ones(len(sets), bool)
        stay[gone] = False
        rest_ids = rest_ids[np.repeat(stay[rest], sizes[rest])]
        rest = rest[stay[rest]]

    while len(rest) > 1:
        queue = [int(rest[0])]
        leave(rest[:1])
        while queue and len(rest):
            i = queue.pop()
            mine = ids[ends[i] - sizes[i] : ends[i]]
            mark[mine] = True
            total = np.r_[0, np.cumsum(mark[rest_ids], dtype=np.int64)]
            mark[mine] = False
            upto = np.cumsum(sizes[rest])
            both = total[upto] - total[upto - sizes[rest]]
            found = rest[both >= similarity * (sizes[i] + sizes[rest] - both)]
            if len(found):
                left += [i] * len(found)
                right += found.tolist()
                queue += found.tolist()
                leave(found)
    return left, right


def alike(groups: DataFrame, texts: DataFrame, size: int, similarity: float, chunk: int = CHUNK) -> DataFrame:
    """src, dst: links that span, within each component of ``groups`` (node, component), the rows whose texts (node, text) share
    that much of their distinct shingles, exactly.

    A component of over ``chunk`` rows is dealt by hash into parts, and each pair of parts is a group for one task.
    """

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([np.unique(shingle_hashes(t.as_py() or b"", size)).tobytes() for t in batch.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], sets], names=["component", "parts", "node", "shingles"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
            component, pair, node = (table.column(c).to_numpy() for c in ("component", "pair", "node"))
            starts = np.flatnonzero(np.r_[True, (component[1:] != component[:-1]) | (pair[1:] != pair[:-1])])
            for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(node)]):
                a, b = verified_links([np.frombuffer(t, np.uint64) for t in table.column("shingles").slice(at, end - at).to_pylist()], similarity)
                if a:
                    label = np.arange(end - at)
                    for x, y in zip(a, b):  # x is in a group already, or begins one
                        label[y] = label[x]
                    least, others = stars(label, node[at:end])
                    yield pa.RecordBatch.from_arrays([pa.array(least[others], pa.int64()), pa.array(node[at:end][others], pa.int64())], names=["src", "dst"])

        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            if held[0].column(0)[0] == batch.column(0)[-1] and held[0].column(1)[0] == batch.column(1)[-1]:
                continue  # one group so far
            table = pa.Table.from_batches(held)
            component, pair = table.column("component").to_numpy(), table.column("pair").to_numpy()
            cut = int(np.flatnonzero((component[1:] != component[:-1]) | (pair[1:] != pair[:-1]))[-1]) + 1
            yield from solve(table.slice(0, cut))  # all but the last group are complete
            held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield from solve(pa.Table.from_batches(held))

    # written out, so that the join has an exchange of its own on both sides and a large component can be split
    counts = cut_lineage(groups.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("parts")))
    joined = groups.join(counts, "component").join(texts, "node").select("component", "parts", "node", "text")
    rows = joined.mapInArrow(shingles, "component long, parts int, node long, shingles binary").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # the rows of a part meet each other wherever that part meets another one
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("part"))
    pair = F.when(F.col("parts") == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(others, lambda x: F.least(x, F.col("part")).cast("long") * F.col("parts") + F.greatest(x, F.col("part")))
    )
    width = max(1, int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.select("component", F.explode(pair).alias("pair"), "node", "shingles").repartition(width, "component", "pair")
    return dealt.sortWithinPartitions("component", "pair", "node").mapInArrow(run, "src long, dst long")


def near_copies(docs: DataFrame, size: int = 5, radii: tuple[int, ...] = RADII, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id: documents grouped whose texts are equal or share ``similarity`` of their ``size``-word shingles.

    Similarity shows as differing bits of a 256-bit fingerprint of the distinct shingles: at 0.8, texts differ in 15 % of the bits, 39 on average; the
    radius of 66 is four to five standard deviations further. Documents meet in blocks by minima of their shingle hashes. Near
    pairs of all blocks make components, which only say which documents may be alike; within each of them documents are
    compared exactly, in blocks of texts under ``SHORT`` shingles all are near, and a group holds nothing but exact links. Equal texts are one node, so copies cost one row. An id with
    several texts is one document, with the links of all of them. Rows with a null id are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, keys = np.zeros((len(batch), WORDS), np.int64), np.zeros((len(batch), BANDS), np.int64)
            digests, counts = np.zeros((len(batch), 2), np.uint64), np.zeros(len(batch), np.int64)
            for i, t in enumerate(batch.column(1)):
                text = t.as_py() or b""
                hashes = np.unique(shingle_hashes(text, size))  # as they are compared
                counts[i] = len(hashes)
                prints[i] = np.packbits(np.concatenate([majority(rehash(hashes, k)) for k in range(WORDS)]), bitorder="little").view(np.int64)
                keys[i] = blocking_keys(hashes)
                digests[i] = divmod(xxhash.xxh3_128_intdigest(text), 1 << 64)
            t0, t1 = (pa.array(digests[:, k].view(np.int64)) for k in (0, 1))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), BANDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), t0, t1, *(pa.array(prints[:, k]) for k in range(WORDS)), pa.array(counts), lists], names=["doc_id", "t0", "t1", *fps, "n_shingles", "keys"])

    fps = [f"fp{k}" for k in range(WORDS)]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).where("doc_id IS NOT NULL")
    made = cut_lineage(rows.mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "t0", "t1", *fps, "n_shingles")) + ", keys array<long>"))
    # equal texts have equal fingerprints and keys, so any of them will do; counted first on narrow rows
    n = made.count()
    texts = cut_lineage(made.groupBy("t0", "t1").agg(F.min("doc_id").alias("node"), *(F.first(c).alias(c) for c in (*fps, "n_shingles", "keys"))), n, 20_000)
    placed = texts.select("node", "n_shingles", F.posexplode("keys").alias("band", "key"), *fps)
    # a short text and its partners, whose size is within the similarity, have blocks of their own, where all are near
    short = placed.where(F.col("n_shingles") * similarity <= SHORT).select(F.xxhash64("band", "key", F.lit("short")).alias("key"), "node", *(F.lit(0).cast("long").alias(c) for c in fps))
    buckets = placed.where(F.col("n_shingles") >= SHORT).select(F.xxhash64("band", "key").alias("key"), "node", *fps).union(short)
    # an id with several texts joins the nodes of all of them
    text = F.struct("t0", "t1")
    several = made.groupBy("doc_id").agg(F.min(text).alias("a"), F.max(text).alias("b")).where("a <> b").select("doc_id")
    same = cut_lineage(made.join(several, "doc_id", "left_semi").join(texts.select("t0", "t1", "node"), ["t0", "t1"]).where("doc_id <> node").select(F.col("doc_id").alias("src"), F.col("node").alias("dst")).distinct())
    near = connected_components(bucket_links(buckets, WORDS, radii, n_rows=BANDS * n).union(same))
    bodies = rows.join(near.select(F.col("node").alias("doc_id")).hint("shuffle_hash"), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "text").distinct()
    groups = connected_components(alike(near, bodies, size, similarity).union(same))
    named = texts.select("t0", "t1", "node").join(groups, "node", "left").select("t0", "t1", F.coalesce("component", "node").alias("component_id"))
    return made.select("doc_id", "t0", "t1").join(named, ["t0", "t1"]).select("doc_id", "component_id")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, but of each group of near copies only those with the smallest id.

    Ids that go are hashed and the texts stream past them. Rows with a null id stay.
    """
    gone = near_copies(docs, id_col=id_col, text_col=text_col).where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(cut_lineage(gone).hint("shuffle_hash"), id_col, "left_anti").select(*docs.columns)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_components(read(spark, sf_dir, "documents", "doc_id", "text"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")
