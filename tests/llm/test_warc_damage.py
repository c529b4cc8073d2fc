"""Archives that are cut, damaged or odd, and conditions tested before payloads."""

from __future__ import annotations

import gzip
import io

import pytest
from pyspark.sql.datasource import EqualTo, StringStartsWith

from haulcost.llm import warc
from haulcost.sources.scratch import new_folder


def made(number, payload=b"payload", kind="response", **changed):
    row = {
        "record_type": kind, "record_id": f"<urn:{number}>", "date": "2024-01-01T00:00:00Z", "target_uri": f"http://x/{number}",
        "payload": payload, "refers_to": "<urn:0>",
    }
    return warc.record(row | changed)


def read(data, tests=(), compressed=False, seekable=False):
    reader = warc.WarcReader({"path": "unused"})
    left = list(reader.pushFilters(list(tests)))
    decoded = []
    payload = reader._payload
    reader._payload = lambda *a: decoded.append(1) or payload(*a)
    raw = io.BytesIO(data)
    stream = io.BufferedReader(warc.Inflated(raw) if compressed else raw, 1 << 16)
    rows = [(r["record_id"][5:-1], r["content_length"], r["payload"]) for r in reader.records(stream)]
    return rows, len(decoded), left


WHOLE = (7, b"payload")


@pytest.mark.parametrize("compressed", [False, True])
def test_cut_anywhere(compressed):
    parts = [made(i) for i in range(3)]
    parts = [gzip.compress(p, mtime=0) for p in parts] if compressed else parts
    data, two = b"".join(parts), len(parts[0] + parts[1])
    for end in range(len(data) + 1):
        rows, _, _ = read(data[:end], compressed=compressed)
        assert [r[0] for r in rows] == ["0", "1", "2"][: len(rows)]
        assert all(r[1:] == WHOLE for r in rows[:-1])
        assert end < two or [r[1:] for r in rows[:2]] == [WHOLE] * 2
    assert [r[1:] for r in rows] == [WHOLE] * 3


def test_line_feeds_only_headless_and_blank_line_less_bodies():
    bare = made(1).replace(b"\r\n", b"\n")
    size = len(bare.split(b"\n\n", 1)[1].removesuffix(b"\n\n"))
    bare = bare.replace(b"Content-Length: %d" % len(made(1).split(b"\r\n\r\n", 1)[1].removesuffix(b"\r\n\r\n")), b"Content-Length: %d" % size, 1)

    def body(number, content, kind=b"application/http"):
        head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:%d>\r\nContent-Type: %s\r\nContent-Length: %d\r\n\r\n"
        return head % (number, kind, len(content)) + content + b"\r\n\r\n"

    data = b"".join([bare, body(2, b"no head\nof a kind"), body(3, b"HTTP/1.1 200 OK\r\nX: y"), body(4, b""), body(5, b"as it is", b"text/plain"),
                     body(6, b"HTTP/1.1 200 OK\nContent-Length: x\n\nodd"), made(7)])
    rows, _, _ = read(data)
    assert rows == [("1", *WHOLE), ("2", 17, b"no head\nof a kind"), ("3", 0, b""), ("4", 0, b""), ("5", 8, b"as it is"), ("6", 3, b"odd"), ("7", *WHOLE)]


def test_wrong_lengths_and_bytes_between_records():
    lost = made(1).replace(b"Content-Length: ", b"Content-Length: x", 1)
    minus = made(2).replace(b"Content-Length: ", b"Content-Length: -", 1)
    rows, _, _ = read(b"\x00\xff stray\n" + lost + minus + b"more\nWARC" + b"\n" + made(3))
    assert rows == [("1", None, None), ("2", None, None), ("3", *WHOLE)]
    long = made(4).replace(b"Content-Length: ", b"Content-Length: 9", 1)
    assert read(long)[0][0][0] == "4" and read(long)[0][0][2] is None


def test_a_damaged_member_is_left():
    parts = [gzip.compress(made(i, b"payload %d " % i * 300), mtime=0) for i in range(4)]
    broken = bytearray(parts[1])
    broken[len(broken) // 2 :] = bytes(x ^ 0x55 for x in broken[len(broken) // 2 :])
    rows, _, _ = read(b"".join([parts[0], bytes(broken), parts[2], b"stray bytes", parts[3]]), compressed=True)
    found = {r[0]: r[2] for r in rows}
    assert {k: v for k, v in found.items() if k != "1"} == {str(i): b"payload %d " % i * 300 for i in (0, 2, 3)}
    assert found.get("1") is None
    one = gzip.compress(made(0) + made(1) + made(2), mtime=0)  # several records in a member
    assert [r[1:] for r in read(one, compressed=True)[0]] == [WHOLE] * 3


def test_unwanted_payloads_are_not_decoded():
    data = b"".join(made(i, kind="revisit" if i % 2 else "response") for i in range(6))
    rows, decoded, left = read(data)
    assert (len(rows), decoded) == (6, 3)
    rows, decoded, left = read(data, [EqualTo(("record_type",), "response"), StringStartsWith(("target_uri",), "http://x/2")])
    assert left == [] and [r[0] for r in rows] == ["2"] and decoded == 1
    rows, decoded, _ = read(gzip.compress(data), [EqualTo(("record_type",), "revisit")], compressed=True)
    assert len(rows) == 3 and decoded == 0


def test_damaged_files_in_a_folder(spark, tmp_path):
    folder = tmp_path / "archives"
    folder.mkdir()
    whole = gzip.compress(made(0), mtime=0) + gzip.compress(made(1), mtime=0)
    (folder / "a.warc.gz").write_bytes(whole[:-20])
    (folder / "b.warc").write_bytes(made(2) + made(3)[:150])
    (folder / "c.warc.gz").write_bytes(b"not an archive")
    (folder / "d.warc").write_bytes(b"")
    (folder / "e.txt").write_bytes(b"ignored")
    rows = {r.record_id[5:-1]: r.payload for r in warc.read_archives(spark, str(folder)).collect() if r.record_id}
    assert bytes(rows["0"]) == bytes(rows["2"]) == b"payload" and rows.get("1") is None
    assert new_folder(spark) and warc.read_archives(spark, str(folder)).filter("record_type = 'revisit'").count() == 0
