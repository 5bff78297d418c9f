"""Writing pages as WARC archives and reading archives back, damaged ones too.

Each task writes its rows to archives of its own in the shared folder, a gzip member a record, and reports them; only archives
that a finished attempt reported are read. Of equal payloads one is stored, in the record of the largest page id, and
the others are revisit records that refer to it. Groups of equal payloads are found by digest, with counts and maxima
combined before the exchange; payloads are not sorted or gathered by group.

The reader streams an archive, compressed by the record, as one member or not at all. A record must decode, parse, and match its length and
digests. After one that does not, it looks for the next gzip member or version line from which a whole valid record follows, goes on there, and
logs the bytes between as quarantined. Memory holds one record: a length that the file or the record's own end contradicts is found out
before the block is read, and a block of over ``MAX_BLOCK`` bytes, more than a row can hold, is quarantined.

Defined results: a null payload is an empty one; a null url gives no target. Rows that share the largest page id of their
payload are all responses; a null page id is below all others. Records of one gzip member share its offset, and all but its last
have it as their end too, as have gaps between them. Payloads are without chunked transfer coding; a revisit's length is that of its HTTP header, null without
one. A gap in archives that ``op5_warc`` wrote itself is an error.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolode.llm.tables import read
from chronolode.session import cut_lineage, shared_path

ARCHIVE_BYTES, READ_BYTES, MAX_HEAD, MAX_BLOCK, DATE = 64 << 20, 1 << 18, 1 << 20, 1 << 30, "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC, VERSION, VERSION_LINE = b"\x1f\x8b\x08", b"WARC/1.", re.compile(rb"WARC/1\.\d+")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def urn_page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One uncompressed record. A revisit has the HTTP header, whose length is the whole payload's, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_urn(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_urn(refers_to))]
    fields += [("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"), ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def compress(record: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


class Damaged(ValueError):
    pass


def without_chunks(body: bytes) -> bytes:
    """The body of a chunked transfer; raises ``Damaged`` where it is none."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].partition(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            raise Damaged("no chunk")
        n, at = int(size, 16), end + 2
        if not n:
            return b"".join(out)
        out.append(body[at : at + n])
        if body[at + n : at + n + 2] != b"\r\n":
            raise Damaged("no chunk")
        at += n + 2


class Record(NamedTuple):
    offset: int
    end: int
    fields: dict[str, str]
    block: bytes

    def is_http(self) -> bool:
        return self.fields.get("content-type", "").startswith("application/http")

    def http_field(self, name: str) -> str | None:
        for line in self.block.partition(b"\r\n\r\n")[0].decode("latin-1").split("\r\n")[1:]:
            key, _, value = line.partition(":")
            if key.strip().lower() == name:
                return value.strip()
        return None

    def body(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2] if self.is_http() else self.block

    def payload(self) -> bytes:
        body = self.body()
        if self.is_http() and (self.http_field("transfer-encoding") or "").lower() == "chunked":
            try:
                return without_chunks(body)
            except Damaged:
                return body
        return body

    def payload_length(self) -> int | None:
        """Bytes of the whole payload, which a revisit does not hold."""
        if self.fields.get("warc-type") != "revisit":
            return len(self.payload())
        length = self.http_field("content-length") or ""
        return int(length) if length.isdigit() and length.isascii() else None

    def check(self) -> None:
        digest = self.fields.get("warc-block-digest", "")
        if digest.startswith("sha1:") and digest[5:] != sha1_base32(self.block):
            raise Damaged("block digest does not hold")
        digest = self.fields.get("warc-payload-digest", "")
        if self.fields.get("warc-type") == "response" and digest.startswith("sha1:") and digest[5:] not in (sha1_base32(self.body()), sha1_base32(self.payload())):
            raise Damaged("payload digest does not hold")


class Gap(NamedTuple):
    start: int
    end: int
    reason: str


class Plain:
    """Bytes of a file from ``offset`` on, without compression."""

    def __init__(self, file: Any, offset: int, size: int) -> None:
        self.file, self.at, self.size = file, offset, size

    def bytes_at(self, start: int, n: int) -> bytes:
        """Up to ``n`` bytes from ``start`` bytes on after the place reached."""
        self.file.seek(self.at + start)
        return self.file.read(max(0, min(n, self.size - self.at - start)))

    def skip(self, n: int) -> None:
        self.at += n


class Member:
    """Bytes of the gzip member at ``offset``, decoded no further than they are asked for."""

    def __init__(self, file: Any, offset: int, size: int) -> None:
        self.file, self.size, self.read_to, self.raw = file, size, offset, b""
        self.unpacker, self.held = zlib.decompressobj(31), bytearray()

    def bytes_at(self, start: int, n: int) -> bytes:
        while len(self.held) < start + n and not self.unpacker.eof:
            if not self.raw:
                self.file.seek(self.read_to)
                self.raw = self.file.read(min(READ_BYTES, self.size - self.read_to))
                self.read_to += len(self.raw)
                if not self.raw:
                    raise Damaged("member is cut off")
            try:
                self.held += self.unpacker.decompress(self.raw, READ_BYTES)
            except zlib.error as e:
                raise Damaged("member does not decode") from e
            self.raw = self.unpacker.unconsumed_tail
        return bytes(self.held[start : start + n])

    def skip(self, n: int) -> None:
        del self.held[:n]

    def end(self) -> int:
        """Where the member, decoded to its end, ends in the file."""
        return self.read_to - len(self.unpacker.unused_data)


def parse(source: Plain | Member) -> tuple[dict[str, str], bytes, int]:
    """Fields, block and length of the record at the place reached, after all its checks."""
    if not source.bytes_at(0, len(VERSION)).startswith(VERSION):
        raise Damaged("no version line")
    n = 4096
    while True:
        head, found, _ = source.bytes_at(0, n).partition(b"\r\n\r\n")
        if found:
            break
        if len(head) < n or n >= MAX_HEAD:
            raise Damaged("header without end")
        n *= 4
    version, *lines = head.split(b"\r\n")
    if not VERSION_LINE.fullmatch(version):
        raise Damaged("no version line")
    fields: dict[str, str] = {}
    last = ""
    for line in lines:
        name, colon, value = line.partition(b":")
        if line[:1] in (b" ", b"\t") and last:  # goes on with the line before
            fields[last] += " " + line.decode("utf-8", "replace").strip()
        elif not colon:
            raise Damaged("header line without colon")
        else:
            last = name.decode("latin-1").strip().lower()
            fields[last] = value.decode("utf-8", "replace").strip()
    if not {"warc-type", "warc-record-id", "warc-date", "content-length"} <= fields.keys():
        raise Damaged("lacks a mandatory field")
    if not re.fullmatch("[0-9]{1,18}", fields["content-length"]):
        raise Damaged("no length")
    start, length = len(head) + 4, int(fields["content-length"])
    if length > MAX_BLOCK:
        raise Damaged("block is too long")
    if source.bytes_at(start + length, 4) != b"\r\n\r\n":
        raise Damaged("length does not hold")
    block = source.bytes_at(start, length)
    Record(0, 0, fields, block).check()
    return fields, block, start + length + 4


def member_records(file: Any, offset: int, size: int) -> Iterator[Record | Gap]:
    """The records of the gzip member at ``offset``; raises ``Damaged`` when it can't be decoded to its end, or holds no record.

    A record is given once what follows it has been decoded, the last one with the member's checksum.
    """
    member, waiting, reason, any_ = Member(file, offset, size), None, "", False
    while member.bytes_at(0, 1):
        try:
            fields, block, n = parse(member)
        except Damaged as e:
            if not member.unpacker.eof and str(e).startswith("member"):
                raise
            reason = reason or str(e)
            # on to the next version line, with the few bytes kept that may be its beginning
            skip = 1
            while (found := member.bytes_at(skip, READ_BYTES).find(VERSION)) < 0 and len(member.bytes_at(skip, READ_BYTES)) == READ_BYTES:
                member.skip(skip + READ_BYTES - len(VERSION))
                skip = 0
            member.skip(skip + found if found >= 0 else len(member.held))
            continue
        member.skip(n)
        if waiting is not None:
            yield waiting
        if reason:
            yield Gap(offset, offset, f"{reason}, inside a member")
        waiting, reason, any_ = Record(offset, offset, fields, block), "", True
    if not any_:
        raise Damaged(reason or "member is empty")
    yield waiting._replace(end=member.end())
    if reason:
        yield Gap(member.end(), member.end(), f"{reason}, inside a member")


def next_start(file: Any, offset: int, size: int) -> int | None:
    """The first place from ``offset`` on where a gzip member or a version line may start."""
    while offset < size:
        file.seek(offset)
        data = file.read(min(1 << 20, size - offset))
        found = [at for at in (data.find(MAGIC), data.find(VERSION)) if at >= 0]
        if found:
            return offset + min(found)
        if offset + len(data) >= size:
            return None
        offset += len(data) - 8
    return None


def salvage(file: Any, size: int) -> Iterator[Record | Gap]:
    """All valid records of an archive in order, and the gaps of bytes between them that hold none."""
    at, gap, reason = 0, None, ""
    while at < size:
        file.seek(at)
        try:
            if file.read(len(MAGIC)) == MAGIC:
                records = member_records(file, at, size)
            else:
                fields, block, n = parse(Plain(file, at, size))
                records = iter([Record(at, at + n, fields, block)])
            for x in records:
                if gap is not None:
                    yield Gap(gap, at, reason)
                    gap = None
                yield x
                end = x.end
            at = end
        except Damaged as e:
            if gap is None:
                gap, reason = at, str(e)
            following = next_start(file, at + 1, size)
            if following is None:
                break
            at = following
    if gap is not None:
        yield Gap(gap, size, reason)


def write_archives(pages: DataFrame, root: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the pages below ``root``; path, records, bytes of each archive."""
    body = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), body.alias("payload"), F.sha1(body).alias("digest"))
    groups = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    groups = cut_lineage(groups.where("n > 1").select("digest", "keeper", F.lit(True).alias("repeated")))
    joined = rows.join(groups.hint("shuffle_hash"), "digest", "left")
    revisit = F.coalesce(F.col("repeated"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    ready = joined.select("page_id", "url", "payload", F.col("keeper"), revisit.alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = pafs.FileSystem.from_uri(root)
        store.create_dir(folder, recursive=True)
        context = TaskContext.get()
        done: list[tuple[str, int, int]] = []
        out, records, size = None, 0, 0

        def finish() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((name, records, size))
                out = None

        for batch in batches:
            columns = [batch.column(i) for i in range(5)]
            for page_id, url, payload, keeper, again in zip(*columns):
                if out is None:
                    name, records, size = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{len(done):04d}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{folder}/{name}", compression=None)
                member = compress(make_record(page_id.as_py(), url.as_py(), payload.as_py(), keeper.as_py(), again.as_py()))
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= ARCHIVE_BYTES:
                    finish()
        finish()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["name", "records", "bytes"])

    return cut_lineage(ready.mapInArrow(run, "name string, records long, bytes long")).select(F.concat(F.lit(f"{root}/"), "name").alias("path"), "records", "bytes")


RECORDS = "path string, offset long, end long, record_type string, record_id string, target_uri string, payload_digest string, payload_bytes long, refers_to string, payload binary, gap_reason string"


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """A row a record, and a row a quarantined gap (``gap_reason`` is set), of the archives in column ``path``."""
    spark = archives.sparkSession
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = [f.split()[0] for f in RECORDS.split(", ")]
    types = [pa.int64() if "long" in f else pa.binary() if "binary" in f else pa.string() for f in RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = pafs.FileSystem.from_uri(path)
                size = store.get_file_info(place).size
                rows: list[tuple] = []
                held = 0
                with store.open_input_file(place) as file:
                    for x in salvage(file, size):
                        if isinstance(x, Gap):
                            rows.append((path, x.start, x.end, *[None] * 7, x.reason))
                        else:
                            f, response = x.fields, x.fields.get("warc-type") == "response"
                            digest = f.get("warc-payload-digest")
                            rows.append((
                                path, x.offset, x.end, f.get("warc-type"), f.get("warc-record-id"), f.get("warc-target-uri"), digest and digest.removeprefix("sha1:"),
                                x.payload_length(), f.get("warc-refers-to"), x.payload() if payloads and response else None, None,
                            ))
                            held += len(x.block) if payloads else 200
                        if held > 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return archives.select("path").repartition(width, "path").mapInArrow(run, RECORDS)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(read(spark, sf_dir, "pages", "page_id", "url", "html"), shared_path(spark, "warc"))
    records = read_archives(archives, payloads=False)
    lost = F.raise_error(F.concat(F.lit("an archive just written has a gap: "), "path", F.lit(": "), "gap_reason"))
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    page = lambda c: F.when(number(c) != "", number(c).cast("long"))
    page_id = F.when(F.col("gap_reason").isNotNull(), lost.cast("long")).otherwise(page(F.col("record_id")))
    return records.select(page_id.alias("page_id"), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to"))
