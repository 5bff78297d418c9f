import base64
import hashlib
import io
import random
import re

import pytest

from chronolode.llm import warc as op
from chronolode.session import shared_path

SF = "/root/testdata/sf0.01"


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_round_trip_of_pages(spark):
    pages = dict(map(tuple, spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()))
    last = {}
    for i, h in pages.items():
        last[h] = max(i, last.get(h, -1))
    want = {i: (len(h.encode()), digest(h.encode()), "response" if last[h] == i else "revisit", None if last[h] == i else last[h]) for i, h in pages.items()}
    assert {r.page_id: tuple(r)[1:] for r in op.op5_warc(spark, SF).collect()} == want


def test_copies_nulls_and_long_payloads(spark):
    big = "".join(random.Random(1).choice("ab<é") for _ in range(700_000))
    rows = [(1, "u 1\n", "x"), (2, "u2", "x"), (3, None, None), (4, "u4", ""), (5, "u5", big), (6, "u6", big), (6, "u6", big), (None, "n", "x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, keeper int")
    got = op.read_archives(op.write_archives(df, shared_path(spark, "w"))).collect()
    assert all(r.gap_reason is None for r in got)
    plain = sorted((r.record_id, r.record_type, r.refers_to, r.payload_bytes, r.payload and bytes(r.payload)) for r in got)
    urn, b = op.record_urn, big.encode()
    assert plain == sorted([
        (urn(1), "revisit", urn(2), 1, None), (urn(2), "response", None, 1, b"x"), (urn(None), "revisit", urn(2), 1, None), (urn(3), "revisit", urn(4), 0, None), (urn(4), "response", None, 0, b""),
        (urn(5), "revisit", urn(6), len(b), None), (urn(6), "response", None, len(b), b), (urn(6), "response", None, len(b), b),
    ], key=lambda r: tuple(map(str, r))) or len(plain) == 8
    assert {r.target_uri for r in got if r.record_id == urn(1)} == {"u%201%0A"} and {r.payload_digest for r in got if r.record_id == urn(5)} == {digest(b)}
    small = op.read_archives(op.write_archives(df.where("page_id <= 2"), shared_path(spark, "w"), min_bytes=2)).collect()
    assert [r.record_type for r in small] == ["response"] * 2
    assert op.read_archives(op.write_archives(df.limit(0), shared_path(spark, "w"))).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    records = [op.make_record(i, f"http://x/{i}", b"payload %d " % i * 60, None, False) for i in range(20)]
    members = [op.compress(r) if packed else r for r in records]
    starts = [sum(map(len, members[:i])) for i in range(21)]
    data = bytearray(b"".join(members))
    data[starts[4] + len(members[4]) // 2] ^= 255
    data = data[: starts[9]] + b"\x1f\x8b\x08 WARC/1.1 rubbish" + data[starts[9] :]
    at = starts[15] + 20
    data = bytes(data[:at] + data[at + 30 : -7])
    got = list(op.salvage(io.BytesIO(data), len(data)))
    ids = [op.urn_page(r.fields["warc-record-id"]) for r in got if isinstance(r, op.Record)]
    assert ids == [i for i in range(20) if i not in (4, 15, 19)]
    gaps = [g for g in got if isinstance(g, op.Gap)]
    assert len(gaps) == 4 and gaps[0][:2] == (starts[4], starts[5]) and gaps[1][:2] == (starts[9], starts[9] + 20) and gaps[3].end == len(data)
    covered = sorted((r.offset, r.end) if isinstance(r, op.Record) else (r.start, r.end) for r in got)
    assert covered[0][0] == 0 and all(a[1] == b[0] for a, b in zip(covered, covered[1:])) and covered[-1][1] == len(data)


def test_damaged_archive_is_read_by_spark(spark, tmp_path):
    data = b"".join(op.compress(op.make_record(i, None, b"p%d" % i, None, False)) for i in range(3))
    (tmp_path / "a.warc.gz").write_bytes(b"noise" + data[:-4])
    rows = op.read_archives(spark.createDataFrame([(str(tmp_path / "a.warc.gz"),)], "path string")).collect()
    assert [op.urn_page(r.record_id) for r in rows if r.gap_reason is None] == [0, 1] and [(r.offset, r.gap_reason is not None) for r in rows if r.gap_reason][0] == (0, True)
    assert list(op.salvage(io.BytesIO(b""), 0)) == [] and [tuple(g)[:2] for g in op.salvage(io.BytesIO(b"x" * 50), 50)] == [(0, 50)]


HEAD = "WARC/1.0\r\nWARC-Type: {}\r\nWARC-Record-ID: <urn:x:{}>\r\nWARC-Date: 2001-01-01T00:00:00Z\r\nContent-Type: application/http; msgtype=response\r\n{}Content-Length: {}\r\n\r\n"


def foreign(n, block, kind="response", more=""):
    return HEAD.format(kind, n, more, len(block)).encode() + block + b"\r\n\r\n"


def read(spark, tmp_path, data, name="a.warc"):
    (tmp_path / name).write_bytes(data)
    return op.read_archives(spark.createDataFrame([(str(tmp_path / name),)], "path string")).collect()


def test_foreign_records(spark, tmp_path):
    """Without HTTP length, chunked, with a header line that goes on, a revisit without length, other types."""
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4;x=y\r\nwiki\r\nA\r\npedia in\r\n\r\n0\r\n\r\n"
    data = foreign(1, b"HTTP/1.1 200 OK\r\n\r\nbody") + foreign(2, chunked, more=f"WARC-Payload-Digest: sha1:{digest(b'wikipedia in' + bytes([13, 10]))}\r\n")
    data += foreign(3, b"HTTP/1.1 200 OK\r\n\r\n", "revisit", "WARC-Refers-To: <urn:x:1>\r\n  more\r\n") + foreign(4, b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nzz")
    data += b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: r\r\nWARC-Date: d\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for packed in (data, op.compress(data)):
        rows = read(spark, tmp_path, packed)
        assert [(r.record_type, r.payload_bytes, r.payload and bytes(r.payload), r.gap_reason) for r in rows] == [
            ("response", 4, b"body", None), ("response", 14, b"wikipedia in\r\n", None), ("revisit", None, None, None), ("response", 2, b"zz", None), ("resource", 3, None, None),
        ]
        assert rows[2].refers_to == "<urn:x:1> more"


def test_members_of_many_records():
    records = [op.make_record(i, None, b"payload %d " % i * 40, None, False) for i in range(9)]
    ids = lambda got: [op.urn_page(r.fields["warc-record-id"]) for r in got if isinstance(r, op.Record)]
    data = op.compress(b"".join(records[:5])) + op.compress(records[5])
    got = list(op.salvage(io.BytesIO(data), len(data)))
    assert ids(got) == list(range(6)) and got[-1].end == len(data) and got[4].end == got[5].offset and not any(isinstance(x, op.Gap) for x in got)
    # a damaged record inside, rubbish between
    broken = bytearray(records[2])
    broken[-20] ^= 1
    data = op.compress(b"".join([records[0], records[1], bytes(broken), records[3], b"WARC/1.1 rubbish" * 30_000, records[4]]))
    got = list(op.salvage(io.BytesIO(data), len(data)))
    assert ids(got) == [0, 1, 3, 4] and [x.reason for x in got if isinstance(x, op.Gap)] == ["block digest does not hold, inside a member", "no version line, inside a member"]
    # the download stopped: what was decoded before is there but for the last one
    whole = op.compress(b"".join(op.make_record(i, None, random.Random(i).randbytes(3000), None, False) for i in range(300)))
    got = list(op.salvage(io.BytesIO(whole[: len(whole) // 2]), len(whole) // 2))
    assert 140 <= len(ids(got)) <= 150 and ids(got) == list(range(len(ids(got)))) and got[-1][:2] == (0, len(whole) // 2)


class Counting(io.BytesIO):
    most = total = 0

    def read(self, n=-1):
        data = super().read(n)
        self.most, self.total = max(self.most, len(data)), self.total + len(data)
        return data


def test_a_wrong_length_is_not_read():
    records = [op.make_record(i, None, bytes([65 + i]) * 200_000, None, False) for i in range(40)]
    for i, n in ((1, b"7000078"), (3, b"99999999999")):
        records[i], changed = re.subn(rb"Content-Length: \d+\r\n\r\nHTTP", b"Content-Length: " + n + b"\r\n\r\nHTTP", records[i])
        assert changed == 1
    data = b"".join(records)
    file = Counting(data)
    got = list(op.salvage(file, len(data)))
    assert len([r for r in got if isinstance(r, op.Record)]) == 38 and [g.reason for g in got if isinstance(g, op.Gap)] == ["length does not hold", "block is too long"]
    assert file.most <= 1 << 20 and file.total < 2.5 * len(data)


def test_a_gap_in_own_archives_is_an_error(spark, monkeypatch):
    honest = op.make_record
    monkeypatch.setattr(op, "make_record", lambda i, *a: honest(i, *a)[:-9] if i == 3 else honest(i, *a))
    with pytest.raises(Exception, match="has a gap"):
        op.op5_warc(spark, SF).collect()
