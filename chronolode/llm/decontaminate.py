"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is found in a document when at least ``threshold`` of the item's distinct five-word shingles are
among the document's. Items are partitioned by their number of shingles (powers of two); an item's signature is
its bottom-k MinHash, the k shingles with the smallest hash values, with k = floor((1 - threshold) u) + 1 for the largest
item u of its partition. An item that is contained lacks fewer than k of its shingles, so one of the signature is
in the document: the search loses nothing, whatever the two lengths. A partition's signatures end at some hash value,
and a document's sketch for the partition is its shingle hashes up to that value; only these are looked up, among the
partition's signatures alone. The items met are candidates, whose shingles are then counted exactly:
they are compared as word sequences, not as hashes.

Documents stream past the items; they are never exchanged. Items are taken in blocks of at most
``ITEM_BYTES`` of text, which bounds what is broadcast for any benchmark. Workers get plain arrays and need no package.

Words are runs of letters, digits and underscores of the lower-cased text. A text of one to four words has one
shingle, all its words. Defined results: null or wordless items and documents have no shingles and are never found. Item rows
of one id are one item with the shingles of all of them (a null id is one id too); document rows of one id give one row an item, that of the most shingles found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolode.llm.tables import read

SIZE, THRESHOLD, ITEM_BYTES, TOGETHER = 5, 0.8, 8 << 20, 256
WORD = re.compile(r"\w+")
SIEVE = (1 << 20) - 1
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def codes(ids: np.ndarray) -> np.ndarray:
    """A 64-bit code for each row of word ids: the hash value that MinHash orders by."""
    with np.errstate(over="ignore"):
        z = (ids.astype(np.uint64) * MIX[: ids.shape[1]]).sum(axis=1, dtype=np.uint64)
        z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return z ^ (z >> np.uint64(29))


class Part(NamedTuple):
    """The signatures of the items of one size: hash values in order, each with an item, the last of them, and a sieve."""

    code: np.ndarray
    item: np.ndarray
    last: int
    sieve: np.ndarray


class Items(NamedTuple):
    """What is broadcast: words, items by number, their distinct shingles one item after another, and the parts."""

    size: int
    threshold: float
    vocabulary: dict[str, int]
    ids: list[int | None]
    ends: np.ndarray  # of each item's shingles
    shingles: np.ndarray  # rows of word ids, of an item by rising hash value
    code: np.ndarray
    parts: list[Part]


def index_items(rows: list[tuple[int | None, str | None]], size: int = SIZE, threshold: float = THRESHOLD) -> Items:
    """Items of (id, text) rows; rows of one id are one item."""
    vocabulary: dict[str, int] = {}
    texts: dict[int | None, list[np.ndarray]] = {}
    for item_id, text in rows:
        words = WORD.findall((text or "").lower())
        if words:
            ids = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], np.int32)
            width = min(size, len(ids))
            cut = np.zeros((len(ids) - width + 1, size), np.int32)
            cut[:, :width] = ids[np.arange(len(cut))[:, None] + np.arange(width)]
            texts.setdefault(item_id, []).append(cut)
    tables, values = [], []
    for cuts in texts.values():
        table = np.unique(np.concatenate(cuts), axis=0)
        code = codes(table)
        order = np.argsort(code, kind="stable")
        tables.append(table[order])
        values.append(code[order])
    sizes = np.array([len(t) for t in tables], np.int64)
    kinds = np.array([int(n).bit_length() for n in sizes.tolist()], np.int64)
    parts = []
    for kind in np.unique(kinds).tolist():
        mine = np.flatnonzero(kinds == kind)
        k = int((1 - threshold) * int(sizes[mine].max()) + 1e-9) + 1
        code = np.concatenate([values[i][:k] for i in mine])
        item = np.repeat(mine, np.minimum(sizes[mine], k))
        order = np.argsort(code, kind="stable")
        sieve = np.zeros(SIEVE + 1, bool)
        sieve[(code & np.uint64(SIEVE)).astype(np.int64)] = True
        parts.append(Part(code[order], item[order], int(code.max()), sieve))
    empty = np.empty((0, size), np.int32)
    return Items(size, threshold, vocabulary, list(texts), np.cumsum(sizes), np.concatenate([empty, *tables]), np.concatenate([np.empty(0, np.uint64), *values]), parts)


def candidates(items: Items, code: np.ndarray, doc: np.ndarray) -> set[tuple[int, int]]:
    """(document, item) pairs that share a signature shingle's hash value: the search by sketches. ``doc`` is the document of each value."""
    out: set[tuple[int, int]] = set()
    low = (code & np.uint64(SIEVE)).astype(np.int64)
    for part in items.parts:
        at = np.flatnonzero((code <= np.uint64(part.last)) & part.sieve[low])
        left, right = np.searchsorted(part.code, code[at], "left"), np.searchsorted(part.code, code[at], "right")
        for d, a, b in zip(doc[at].tolist(), left.tolist(), right.tolist()):
            if a < b:
                out.update((d, i) for i in part.item[a:b].tolist())
    return out


def shared_shingles(items: Items, item: int, rows: np.ndarray, code: np.ndarray) -> int:
    """How many of an item's shingles are among ``rows`` (word ids, by rising ``code``), compared word by word."""
    end = int(items.ends[item])
    start = int(items.ends[item - 1]) if item else 0
    mine, words = items.code[start:end], items.shingles[start:end]
    left, right = np.searchsorted(code, mine, "left"), np.searchsorted(code, mine, "right")
    return sum(bool((rows[a:b] == w).all(axis=1).any()) for a, b, w in zip(left.tolist(), right.tolist(), words) if a < b)


def found(items: Items, texts: list[str | None]) -> list[tuple[int, int | None, int, int]]:
    """(place in ``texts``, item id, its shingles, those found) of the items contained in the texts."""
    size, get = items.size, items.vocabulary.get
    pieces, owners, gap = [], [], np.zeros(size, np.int32)  # words that no item has keep shingles inside their text
    short: list[tuple[int, np.ndarray]] = []
    for n, text in enumerate(texts):
        words = WORD.findall((text or "").lower())
        ids = np.fromiter(map(get, words, [0] * len(words)), np.int32, len(words))
        if len(words) >= size:
            pieces += [ids, gap]
            owners.append((n, len(ids) + size))
        elif words and ids.all():
            short.append((n, np.r_[ids, gap[len(ids) :]]))
    rows, doc = np.empty((0, size), np.int32), np.empty(0, np.int64)
    if pieces:
        flat = np.concatenate(pieces)
        unknown = np.r_[0, np.cumsum(flat == 0)]
        at = np.flatnonzero(unknown[size:] == unknown[:-size])
        rows = flat[at[:, None] + np.arange(size)]
        doc = np.array([n for n, _ in owners])[np.searchsorted(np.cumsum([m for _, m in owners]), at, "right")]
    if short:
        rows = np.concatenate([rows, np.array([r for _, r in short], np.int32)])
        doc = np.r_[doc, [n for n, _ in short]]
    code = codes(rows)
    pairs = candidates(items, code, doc)
    out = []
    for d in sorted({d for d, _ in pairs}):
        here = np.flatnonzero(doc == d)
        here = here[np.argsort(code[here], kind="stable")]
        mine, values = rows[here], code[here]
        for i in sorted(i for e, i in pairs if e == d):
            whole = int(items.ends[i]) - (int(items.ends[i - 1]) if i else 0)
            both = shared_shingles(items, i, mine, values)
            if both >= items.threshold * whole - 1e-9:
                out.append((d, items.ids[i], whole, both))
    return out


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = SIZE, threshold: float = THRESHOLD) -> Iterator[Items]:
    """The items in blocks of about ``ITEM_BYTES`` of text each; rows of one id are in one block."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-int(total) // ITEM_BYTES) or 1
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        yield index_items([tuple(r) for r in part.collect()], size, threshold)


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, n_shingles, n_found: a row for each item contained in a document of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "item_id", "n_shingles", "n_found"]
    out = None
    for block in item_blocks(items):
        sent = spark.sparkContext.broadcast(tuple(block[:-1]) + ([tuple(p) for p in block.parts],))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            *most, parts = sent.value
            index = Items(*most, [Part(*p) for p in parts])
            for batch in batches:
                for at in range(0, len(batch), TOGETHER):
                    part = batch.slice(at, TOGETHER)
                    ids, hits = part.column(0), found(index, part.column(1).to_pylist())
                    if hits:
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array([h[0] for h in hits])), *(pa.array([h[i] for h in hits], pa.int64()) for i in (1, 2, 3))], names=names)

        mine = rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))
        out = mine if out is None else out.union(mine)
    return out.groupBy("doc_id", "item_id").agg(F.max("n_shingles").alias("n_shingles"), F.max("n_found").alias("n_found"))


def clean_documents(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, in which no item is contained. Rows stay where they are."""
    at = docs.columns.index(text_col)
    for block in item_blocks(items):
        sent = docs.sparkSession.sparkContext.broadcast(tuple(block[:-1]) + ([tuple(p) for p in block.parts],))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            *most, parts = sent.value
            index = Items(*most, [Part(*p) for p in parts])
            for batch in batches:
                for start in range(0, len(batch), TOGETHER):
                    part = batch.slice(start, TOGETHER)
                    clean = np.ones(len(part), bool)
                    clean[[h[0] for h in found(index, part.column(at).to_pylist())]] = False
                    yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = contained_items(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))
    return hits.withColumn("containment", F.col("n_found") / F.col("n_shingles"))


CONTAINED_CTE = r"""
doc_words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+') AS w FROM {docs}),
item_words AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+') AS w FROM benchmark),
doc_shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM doc_words WHERE len(w) > 0)),
item_shingles AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0)),
item_sizes AS (SELECT item_id, count(*)::BIGINT AS n_shingles FROM item_shingles GROUP BY item_id),
contained AS (
  SELECT d.doc_id, i.item_id, any_value(z.n_shingles) AS n_shingles, count(*)::BIGINT AS n_found
  FROM doc_shingles d JOIN item_shingles i USING (s) JOIN item_sizes z ON z.item_id = i.item_id
  GROUP BY d.doc_id, i.item_id HAVING count(*) >= 0.8 * any_value(z.n_shingles))
"""
OP8_SQL = (
    "WITH " + CONTAINED_CTE.format(docs="documents") + """
SELECT doc_id, item_id, n_shingles, n_found, n_found::DOUBLE / n_shingles AS containment FROM contained"""
)
