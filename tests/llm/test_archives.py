"""WARC records in ZIP archives: round trips, the directories' odd shapes, and damage."""

import base64
import glob
import hashlib
import io
import uuid
import zipfile

import pytest

from quern.llm.warc import base32_digest, page_records, parsed, read_records, record, record_places, unpacked, write_archives, archives
from quern.llm.zip_archive import ZipStream, members


def reader(raw):
    return lambda offset, length: raw[offset : offset + length]


def archive(entries, gap=0, zip64=False):
    out = ZipStream(gap, zip64)
    pieces = [out.member(name, data) for name, data in entries] + list(out.directory())
    return b"".join(x + b"\n" * gap for x in pieces)


@pytest.mark.parametrize("gap", [0, 1])
@pytest.mark.parametrize("zip64", [False, True])
def test_stream_is_a_zip(gap, zip64):
    entries = [(f"archive/é{i}", bytes([i]) * i) for i in range(40)]
    raw = archive(entries, gap, zip64)
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None and [(n, z.read(n)) for n in z.namelist()] == entries
    found = list(members(reader(raw), len(raw)))
    assert [(m.name, raw[m.start : m.start + m.size]) for m in found] == entries and all(m.stored for m in found)


def test_foreign_zips():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("a", b"x" * 1000, zipfile.ZIP_STORED)
        z.writestr("b", b"x" * 1000, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 is no end record here"
    raw = raw.getvalue()
    assert [(m.name, m.stored) for m in members(reader(raw), len(raw))] == [("a", True), ("b", False)]
    many = archive([(str(i), b"") for i in range(70_000)])  # more than 16 bits count
    assert sum(1 for _ in members(reader(many), len(many))) == 70_000 and len(zipfile.ZipFile(io.BytesIO(many)).namelist()) == 70_000
    empty = archive([])
    assert list(members(reader(empty), len(empty))) == []


def test_far_offsets():
    """Directory fields beyond 32 bits, without 4 GB of bytes: what lies before the tail is never read but for headers."""
    out = ZipStream()
    head = out.member("near", b"1")
    out.at = 5 << 32
    far = out.member("far", b"22")
    tail = next(iter(out.directory()))

    def read(offset, length):
        for start, piece in ((0, head), (5 << 32, far + tail)):
            if start <= offset < start + len(piece):
                return piece[offset - start : offset - start + length]
        return b"\0" * length if offset + length < 5 << 32 else b"\0" * ((5 << 32) - offset) + (far + tail)[: length - ((5 << 32) - offset)]

    assert [(m.name, m.size) for m in members(read, (5 << 32) + len(far + tail))] == [("near", 1), ("far", 2)]


@pytest.mark.parametrize("raw", [b"", b"no zip", b"PK\x05\x06" + b"\0" * 10])
def test_no_archive(raw):
    with pytest.raises(ValueError):
        list(members(reader(raw), len(raw)))


def test_cut_off():
    raw = archive([("a", b"1"), ("b", b"2")])
    with pytest.raises(ValueError):
        list(members(reader(raw[:-5]), len(raw) - 5))


def test_records_one_by_one():
    made = [record("response", f"urn:page:{i}:D", "http://h/\r\nx", b"\xff" * i, base32_digest(b"\xff" * i), i, None) for i in (0, 1, 9_000_000)]
    raw = b"".join(made)
    found = [parsed(x) for x in unpacked(reader(raw), 0, len(raw))]
    assert [(len(x[3]), x[5], x[2]) for x in found] == [(n, n, "http://h/%0D%0Ax") for n in (0, 1, 9_000_000)]
    with pytest.raises(ValueError):
        list(unpacked(reader(raw[:-3]), 0, len(raw)))
    with pytest.raises(ValueError):
        parsed(next(unpacked(reader(record("response", "r", None, b"a", base32_digest(b"b"), 1, None)), 0, 10_000)))


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.mark.parametrize("least", [0, 4])
def test_round_trip(spark, tmp_path, monkeypatch, least):
    from quern.llm import warc

    monkeypatch.setattr(warc, "MEMBER", 2000)  # several members an archive
    pages = [(i, f"http://h/{i}", ["<p>one", "ü", "", None, "x" * 5000][i % 5]) for i in range(60)]
    pages += [(None, "u", "<p>one"), (None, None, "alone"), (None, None, "alone"), (7, "again", "twice!"), (7, "again", "twice!"), (8, None, "x" * 5000), (-5, "low", "\r\n\r\n&")]
    table = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, digest string")
    path = f"file://{tmp_path}/{uuid.uuid4().hex}"
    write_archives(page_records(table.repartition(3), least=least), path, zip64=bool(least))
    found = [(r.record_type, r.record_id, r.url, r.payload, r.payload_digest, r.payload_bytes, r.refers_to) for r in read_records(spark, path).collect()]
    assert len(found) == len(pages) and len({x[1] for x in found}) == len(pages)
    groups = {}
    for page, url, html in pages:
        groups.setdefault(html or "", []).append((page, url))
    for html, rows in groups.items():
        mine = [x for x in found if x[4] == digest(html)]
        assert len(mine) == len(rows) and {x[5] for x in mine} == {len(html.encode())}
        responses = [x for x in mine if x[0] == "response"]
        if len(html.encode()) < least:
            assert len(responses) == len(rows) and all(x[6] is None and x[3] == html.encode() for x in responses)
            continue
        first = min(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
        assert [(x[2], x[3], x[6]) for x in responses] == [(first[1], html.encode(), None)]
        name = f"urn:page:{'%' if first[0] is None else first[0]}:{digest(html)}"
        assert responses[0][1] == name and {x[6] for x in mine if x[0] == "revisit"} <= {name}
        assert sorted(str(x[2]) for x in mine) == sorted(str(r[1]) for r in rows)
    for name in glob.glob(f"{path[7:]}/part*"):
        assert zipfile.ZipFile(name).testzip() is None


def test_without_index(spark, tmp_path):
    raw = b"".join(record("response", f"r{i}", None, b"%d" % i, base32_digest(b"%d" % i), 1, None) for i in range(5)) + record("warcinfo", "i", None, b"", "", 0, None)
    (tmp_path / "a.wacz").write_bytes(archive([("archive/x.warc.gz", raw), ("fuzzy.json", b"{}")], zip64=True))
    assert [r.whole for r in record_places(archives(spark, str(tmp_path))).collect()] == [True]
    assert sorted(r.record_id for r in read_records(spark, str(tmp_path)).collect()) == [f"r{i}" for i in range(5)]


def test_no_pages(spark, tmp_path):
    write_archives(page_records(spark.createDataFrame([], "page_id long, url string, html string")), f"{tmp_path}/none")
    assert read_records(spark, f"{tmp_path}/none").collect() == []
