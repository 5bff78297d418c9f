"""Packing of tokenized documents into sequences by non-negative least squares.

A task packs its own documents, a block of at most about four million ids at a time, so nothing is exchanged
and memory does not grow with the table. In a block, whole windows of long documents are sequences as they
are. The lengths of what remains make a histogram over bins of 32 ids; the combinations of one to three bins that
fill a window are enumerated, non-negative least squares finds how often each should be used, the counts are
rounded, and pieces are dealt to them. What room is left in those sequences, and all further sequences, are filled
greedily from the pieces that remain, cut where a sequence ends. The last ids of a block are cut
into sequences whose lengths are powers of two, which need no padding.

Defined results: a null or empty text is the end id alone. Null or repeated doc_ids are packed as separate rows.
"""

from __future__ import annotations

import gc
import json
import os
import re
import sys
import types
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolode.llm.tables import read

WINDOW, UNIT, BLOCK_IDS, TABLE = 2048, 32, 1 << 22, 600_000


@cache
def combinations(units: int, deepest: int = 3) -> np.ndarray:
    """Columns: how many of each bin 1..units a combination of at most ``deepest`` bins summing to ``units`` uses."""
    found: list[tuple[int, ...]] = [(units,)]
    found += [(a, units - a) for a in range(1, units // 2 + 1)]
    if deepest > 2:
        found += [(a, b, units - a - b) for a in range(1, units // 3 + 1) for b in range(a, (units - a) // 2 + 1)]
    out = np.zeros((units, len(found)))
    for k, c in enumerate(found):
        for x in c:
            out[x - 1, k] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray, most: int = 400) -> np.ndarray:
    """Least squares under x >= 0 by Lawson and Hanson's active sets."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    slope = a.T @ b
    for _ in range(most):
        gain = np.where(passive, -np.inf, slope)
        j = int(gain.argmax())
        if gain[j] <= 1e-9 * max(1.0, float(np.abs(b).max())):
            break
        passive[j] = True
        while True:
            s = np.zeros_like(x)
            s[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            bad = passive & (s <= 1e-12)
            if not bad.any():
                break
            step = (x[bad] / np.maximum(x[bad] - s[bad], 1e-300)).min()
            x += step * (s - x)
            passive &= x > 1e-12
        x = s
        slope = a.T @ (b - a @ x)
    return x


def pack_lengths(lengths: list[int], window: int = WINDOW, unit: int = UNIT) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, start, length): every id of every item in exactly one piece.

    Every sequence fills the window or has a power of two of ids.
    """
    out: list[list[tuple[int, int, int]]] = []
    bins: list[list[tuple[int, int, int]]] = [[] for _ in range(window // unit + 1)]
    for item, n in enumerate(lengths):
        whole = n - n % window
        out += [[(item, at, window)] for at in range(0, whole, window)]
        if n > whole:
            bins[-(-(n - whole) // unit)].append((item, whole, n - whole))
    table = combinations(window // unit)
    have = np.array([len(b) for b in bins[1:]])
    counts = np.rint(nnls(table, have.astype(float))).astype(int)
    open_: list[list[tuple[int, int, int]]] = []
    for k in np.flatnonzero(counts).tolist():
        uses = {int(u): int(table[u, k]) for u in np.flatnonzero(table[:, k])}
        for _ in range(min(int(counts[k]), *(int(have[u]) // c for u, c in uses.items()))):
            open_.append([bins[u + 1].pop() for u, c in uses.items() for _ in range(c)])
            for u, c in uses.items():
                have[u] -= c
    rest = [p for b in bins for p in b]  # longest last
    done = 0
    while done < len(open_):
        seq = open_[done]
        room = window - sum(p[2] for p in seq)
        while room and (rest or len(open_) > done + 1):
            if not rest:
                rest = open_.pop()
            item, start, n = rest.pop()
            seq.append((item, start, min(n, room)))
            if n > room:
                rest.append((item, start + room, n - room))
            room -= min(n, room)
        if room:
            rest = open_.pop()
            break
        done += 1
    out += open_
    left, target = sum(p[2] for p in rest), 0
    seq, room = [], 0
    while left:
        if not room:
            target = window if left >= window else 1 << left.bit_length() - 1
            seq, room = [], target
            out.append(seq)
        item, start, n = rest.pop()
        take = min(n, room)
        seq.append((item, start, take))
        if n > take:
            rest.append((item, start + take, n - take))
        room -= take
        left -= take
    return out


#: A lower-cased chunk that is one word of letters, composed and lower-case as they stand, and ASCII signs after it.
PLAIN = re.compile(r"([a-z\u00df-\u00f6\u00f8-\u00ff]+)([!-/:-@\[-^`{-~]*)")


# How a tokenizer must normalise and split for its chunks to be encoded one by one.
CHUNKED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def groups(texts: list[str], most: int = 2048, chars: int = 1 << 22) -> Iterator[list[str]]:
    """Runs of at most ``most`` texts and, but for single longer ones, ``chars`` characters."""
    held, size = [], 0
    for t in texts:
        if held and (len(held) == most or size + len(t) > chars):
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


class WholeTokenizer:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, by any tokenizer of the library, text by text."""

    def __init__(self, model) -> None:
        self.model = model

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        for part in groups(texts, 256):
            for e in self.model.encode_batch_fast(part, add_special_tokens=False):
                yield np.array(e.ids, "<u4").tobytes()

    def forget(self) -> None:
        pass


class ChunkTokenizer:
    """The same by a table of chunks between blanks, for tokenizers that normalise and split as ``CHUNKED`` says.

    The tokenizer never joins text across white space, or letters with signs, so a text's ids are its chunks' ids in a
    row and a plain chunk's those of its word and its signs. New plain words are encoded together, by the same
    vocabulary without the normalising that they do not need; all else goes through the whole tokenizer.
    The table past its bound becomes the old one, from which what is met again is taken over.
    """

    def __init__(self, model, bare: dict) -> None:
        from tokenizers import Tokenizer

        self.model = model
        split = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        bare = bare | {"normalizer": None, "post_processor": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, split]}}
        self.bare = Tokenizer.from_str(json.dumps(bare))
        self.known: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def learn_words(self, new: list[str]) -> None:
        """Puts the ids of plain words in the table; ``word_ids`` of one encoding tell where each word's ids end."""
        for i in range(0, len(new), 512):
            part = new[i : i + 512]
            e = self.bare.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(e.ids, "<u4").tobytes()
            ends = (4 * np.searchsorted(np.array(e.word_ids), np.arange(len(part)), "right")).tolist()
            self.known.update(zip(part, map(ids.__getitem__, map(slice, [0, *ends], ends))))

    def forget(self) -> None:
        self.known, self.old = {"": b""}, {}

    def take_over(self, new: set[str]) -> set[str]:
        """Moves what the old table has of ``new`` to the table and returns the rest."""
        again = new.intersection(self.old)
        self.known.update(zip(again, map(self.old.__getitem__, again)))
        return new.difference(again)

    def learn(self, new: set[str]) -> None:
        known = self.known
        words, made, other = set(), [], []
        for c in self.take_over(new):
            m = PLAIN.fullmatch(c.lower())
            if not m:
                other.append(c)
            elif c == m[1]:
                words.add(c)
            else:
                made.append((c, *m.groups()))
        signs = {s for _, _, s in made}.difference(known)
        for i in range(0, len(other := other + list(signs)), 4096):
            part = other[i : i + 4096]
            for c, e in zip(part, self.model.encode_batch_fast(part, add_special_tokens=False)):
                known[c] = np.array(e.ids, "<u4").tobytes()
        self.learn_words(list(words | self.take_over({w for _, w, _ in made}.difference(known, words))))
        known.update([(c, known[w] + known[s]) for c, w, s in made])

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        for part in groups(texts):
            if len(self.known) > TABLE:
                self.known, self.old = {"": b""}, self.known
            parts = [t.replace("\n", " ").split(" ") for t in part]
            self.learn(set().union(*parts).difference(self.known))
            get = self.known.__getitem__
            for p in parts:
                yield b"".join(map(get, p))


def text_tokenizer(path: str) -> ChunkTokenizer | WholeTokenizer:
    """The tokenizer of a ``tokenizers`` file; by chunks where its way of splitting text is known to allow that."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        described = json.load(f)
    fits = all(described.get(k) == v for k, v in CHUNKED.items()) and described["model"].get("end_of_word_suffix") == "</w>"
    return ChunkTokenizer(model, described) if fits else WholeTokenizer(model)


def worker_tokenizer(path: str) -> ChunkTokenizer | WholeTokenizer:
    """The worker's tokenizer for ``path``; with its tables it lasts as long as the worker, over all its tasks."""
    kept = sys.modules.setdefault("_chronolode_worker", types.ModuleType("_chronolode_worker")).__dict__
    if path not in kept:
        kept[path] = text_tokenizer(path)
    return kept[path]


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, keep_table: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids (binary), doc_tokens, sequence_id, offset: one row a piece.

    Sequence ids are unique over the table: the task's partition in the high bits, a running number in the low.
    With ``keep_table`` a worker keeps its table of chunks for its next task, at up to 200 MB while it waits.
    """
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, first = worker_tokenizer(tokenizer_path), TaskContext.get().partitionId() << 40
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal first
            columns: list[list] = [[] for _ in names]
            pending = 0
            for seq in pack_lengths([len(ids) // 4 for _, ids in held]):
                offset = 0
                for item, start, n in seq:
                    doc_id, ids = held[item]
                    for column, value in zip(columns, (doc_id, start, n, ids[4 * start : 4 * (start + n)], len(ids) // 4, first, offset)):
                        column.append(value)
                    offset += n
                first += 1
                pending += offset
                if pending > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
                    columns, pending = [[] for _ in names], 0
            if pending:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        gc.disable()  # the tables are large and hold no cycles
        try:
            for batch in batches:
                for at in range(0, len(batch), 2048):
                    part = batch.slice(at, 2048)
                    texts = [t or "" for t in part.column(1).to_pylist()]
                    for doc_id, ids in zip(part.column(0).to_pylist(), tokenizer.ids(texts)):
                        held.append((doc_id, ids + end))
                        size += len(ids) // 4 + 1
                        if size >= BLOCK_IDS:
                            yield from flush()
                            held, size = [], 0
            if held:
                yield from flush()
        finally:
            gc.enable()
            if not keep_table:
                tokenizer.forget()
            pa.default_memory_pool().release_unused()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def packed_pieces(docs: DataFrame, tokenizer_path: str | None = None, keep_table: bool = True) -> DataFrame:
    """``pack_documents`` with each piece's ids as their CRC-32."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    pieces = pack_documents(docs, tokenizer_path, keep_table=keep_table)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(read(spark, sf_dir, "documents", "doc_id", "text"))
