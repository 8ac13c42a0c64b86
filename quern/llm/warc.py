"""WARC records in ZIP-packaged archives: written with an index, read back record by record from ranges of the archives."""

from __future__ import annotations

import base64
import hashlib
import io
import json
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.zip_archive import Read, ZipStream, members, open_ranges

#: Bytes of records after which a member of an archive ends, and that one range read fetches at most (records of more come alone).
MEMBER, READ = 8 << 20, 8 << 20
#: Bytes of an archive that are dealt out together; there are as many tasks as stretches.
STRETCH = 16 << 20
#: Fixed values of the formats: where data and indexes lie in an archive, and what a revisit says it is.
DATA, INDEX = "archive/data-{:05}.warc.gz", "indexes/data-{:05}.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
RECORD = "record_id string, record_type string, url string, payload binary, payload_digest string, payload_bytes long, refers_to string"


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, digest: str, copy: int) -> str:
    """A record's URI: a null page_id is %, which no quoted one is."""
    name = "%" if pd.isna(page_id) else quote(str(page_id), safe="")
    return f"urn:page:{name}:{digest}" + (f":{copy}" if copy else "")


def page_of(record: Column, kind: str = "long") -> Column:
    """The page_id (a number) in a record's URI; null for the null one."""
    return F.nullif(F.regexp_extract(record, r"^urn:page:(-?[0-9]*)", 1), F.lit("")).cast(kind)


def record(kind: str, name: str, url: str | None, payload: bytes, digest: str, size: int, refers_to: str | None) -> bytes:
    """A gzipped WARC record: a response with its payload, or a revisit of one. Its Payload-Length is an extension field."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + payload if kind == "response" else http
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if kind == "revisit":
        fields += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", PROFILE)]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Payload-Length", str(size)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + block + b"\r\n\r\n") + pack.flush()


def parsed(raw: bytes) -> tuple | None:
    """A record's RECORD columns; None for records of other types. Raises ValueError if it is cut off or a response's payload
    is not what its digest says."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record begins here")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    kind, size = fields["warc-type"], int(fields["content-length"])
    if len(rest) < size:
        raise ValueError(f"record {fields.get('warc-record-id')} is cut off")
    if kind not in ("response", "revisit"):
        return None
    payload = rest[:size].partition(b"\r\n\r\n")[2] if kind == "response" else None
    digest = fields.get("warc-payload-digest", "").rpartition(":")[2]
    if payload is not None and digest != (found := base32_digest(payload)):
        if digest:
            raise ValueError(f"record {fields.get('warc-record-id')} does not hold what its digest says")
        digest = found
    length = len(payload) if payload is not None else fields.get("warc-payload-length")
    plain = lambda x: x.strip("<>") if x else None
    return plain(fields.get("warc-record-id")), kind, fields.get("warc-target-uri"), payload, digest, None if length is None else int(length), plain(fields.get("warc-refers-to"))


def page_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """page_id, url, digest (hex SHA-1), size, copy, first (struct of the response's page_id, url; null for responses), html
    (null for revisits) of every page. Of pages with equal payloads of `least` bytes or more the one of smallest page_id
    (null last, then by url) is the response; repeated rows are copies of one another, the second a revisit of the first.
    A null html is an empty payload. A payload moves once from each task that holds it, however many pages share it."""
    order = lambda: F.struct(F.col("page_id").isNull().alias("a"), "page_id", F.col("url").isNull().alias("b"), "url")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8"))).withColumn("size", F.octet_length("html").cast("long"))
    shared = rows.where(F.col("size") >= least)
    responses = shared.groupBy("digest").agg(F.min(order()).alias("at"), F.first("size").alias("size"), F.first("html").alias("html"))
    same = shared.groupBy("digest", "size", "page_id", "url").agg(F.count("*").alias("n"))
    firsts = shared.groupBy("digest").agg(F.min(order()).alias("at"))
    same = same.join(firsts, "digest").withColumn("is_first", order() == F.col("at")).where(~F.col("is_first") | (F.col("n") > 1))
    copies = F.explode(F.sequence(F.when(F.col("is_first"), 1).otherwise(0).cast("long"), F.col("n") - 1)).alias("copy")
    first = F.struct(F.col("at.page_id").alias("page_id"), F.col("at.url").alias("url"))
    none = F.lit(None).cast(f"struct<page_id:{pages.schema[page_id].dataType.simpleString()},url:string>")
    found = responses.select("at.page_id", "at.url", "digest", "size", F.lit(0).cast("long").alias("copy"), none.alias("first"), "html")
    found = found.unionByName(same.select("page_id", "url", "digest", "size", copies, first.alias("first"), F.lit(None).cast("string").alias("html")))
    if least > 0:
        small = rows.where(F.col("size") < least).groupBy("digest", "size", "page_id", "url", "html").agg(F.count("*").alias("n"))
        found = found.unionByName(small.select("page_id", "url", "digest", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"), none.alias("first"), "html"))
    return found


def write_archives(records: DataFrame, path: str, zip64: bool = False) -> None:
    """Writes page_records() as ZIP archives under `path`, one a partition, each with members of gzipped WARC records and an
    index after each member. The archive is a stream of rows for Spark's text sink, so it may be of any size, lies on any
    file system that Spark writes to, and an attempt that fails leaves nothing; the sink's new lines fall between members,
    the last is the archive's comment. No records, no archives.
    """

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, data, index = ZipStream(1, zip64), io.BytesIO(), []

        def close() -> pd.DataFrame:
            n = len(out.entries) // 2
            made = [out.member(DATA.format(n), data.getvalue()), out.member(INDEX.format(n), "".join(index).encode())]
            data.seek(0)
            data.truncate()
            index.clear()
            return pd.DataFrame({"piece": made})

        for batch in batches:
            for page, url, digest, size, copy, first, html in zip(*(batch[x] for x in ("page_id", "url", "digest", "size", "copy", "first", "html")), strict=True):
                digest = base64.b32encode(bytes.fromhex(digest)).decode()
                refers_to = None if html is not None else record_id(first, digest, 0)
                kind, name = "response" if html is not None else "revisit", record_id(page, digest, copy)
                raw = record(kind, name, url, (html or "").encode(), digest, size, refers_to)
                index.append(json.dumps({"offset": data.tell(), "length": len(raw), "filename": DATA.format(len(out.entries) // 2), "id": name, "type": kind}) + "\n")
                data.write(raw)
                if data.tell() >= MEMBER:
                    yield close()
        if index:
            yield close()
        if out.entries:
            for piece in out.directory():
                yield pd.DataFrame({"piece": [piece]})

    # ids go as text, so that neither nulls nor great numbers turn into fractions
    rows = records.select(F.col("page_id").cast("string").alias("page_id"), "url", "digest", "size", "copy", F.col("first.page_id").cast("string").alias("first"), "html")
    rows.mapInPandas(pieces, "piece binary").select(F.col("piece").cast("string")).write.option("compression", "none").text(path)


def archives(spark: SparkSession, path: str) -> DataFrame:
    """path, length of the files under `path`, without their contents."""
    return spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")


def record_places(found: DataFrame, opener: Callable[[str], Read] = open_ranges) -> DataFrame:
    """path, at, length, whole of the records in archives (path, length): what the indexes say, and where a data member has no
    index, its whole place (whole is true). An index is taken for the member that its lines name. Compressed members
    cannot be read by ranges and raise ValueError."""

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, length in zip(batch["path"], batch["length"], strict=True):
                read = opener(path)
                data, indexed = {}, set()
                listed = list(members(read, length))
                for m in listed:
                    if m.name.startswith("archive/"):
                        if not m.stored:
                            raise ValueError(f"{path}: {m.name} is compressed, so that its records have no places")
                        data[m.name] = m
                for m in listed:
                    if m.name.startswith("indexes/") and m.stored:
                        lines = [json.loads(x) for x in _lines(read, m.start, m.size)]
                        rows = [(path, data[x["filename"]].start + x["offset"], x["length"], False) for x in lines]
                        indexed |= {x["filename"] for x in lines}
                        yield pd.DataFrame(rows, columns=["path", "at", "length", "whole"])
                rest = [(path, m.start, m.size, True) for m in data.values() if m.name not in indexed]
                yield pd.DataFrame(rest, columns=["path", "at", "length", "whole"])

    return found.repartition("path").mapInPandas(places, "path string, at long, length long, whole boolean")


def _lines(read: Read, start: int, size: int) -> Iterator[bytes]:
    """The lines of a range, read READ bytes at a time."""
    held, at = b"", start
    while at < start + size:
        part = read(at, min(READ, start + size - at))
        if not part:
            raise ValueError("an index ends early")
        at += len(part)
        *whole, held = (held + part).split(b"\n")
        yield from whole
    if held:
        yield held


def unpacked(read: Read, start: int, size: int) -> Iterator[bytes]:
    """The gzipped records of a range one after the other, read READ bytes at a time."""
    at, held = start, b""
    while held or at < start + size:
        pack, parts = zlib.decompressobj(31), []
        while not pack.eof:
            if not held:
                held = read(at, min(READ, start + size - at)) if at < start + size else b""
                if not held:
                    raise ValueError("a record ends early")
                at += len(held)
            parts.append(pack.decompress(held))
            held = pack.unused_data
        yield b"".join(parts)


def read_records(spark: SparkSession, path: str, opener: Callable[[str], Read] = open_ranges) -> DataFrame:
    """RECORD of the responses and revisits in the ZIP archives under `path`; payloads of revisits are null.

    Directories and indexes tell where the records lie. These places are dealt out by stretches of STRETCH bytes of an archive,
    and what lies side by side is fetched in one range read. opener(uri) gives the range reads of a file. A response is
    held against its digest; damaged archives and records raise ValueError. Empty files hold no records.
    """

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, read = None, None
        for batch in batches:
            wanted = list(zip(batch["path"], batch["at"], batch["length"], batch["whole"], strict=True))
            i = 0
            while i < len(wanted):
                path, at, length, whole = wanted[i]
                if path != name:
                    name, read = path, opener(path)
                k = i + 1
                while k < len(wanted) and not whole and not wanted[k][3] and wanted[k][0] == path and wanted[k][1] == at + length and length + wanted[k][2] <= READ:
                    length += wanted[k][2]
                    k += 1
                rows = []
                size = 0
                for raw in unpacked(read, at, length):
                    if (row := parsed(raw)) is not None:
                        rows.append(row)
                        size += len(raw)
                    if size >= READ:
                        yield pd.DataFrame(rows, columns=_NAMES)
                        rows, size = [], 0
                yield pd.DataFrame(rows, columns=_NAMES)
                i = k

    found = archives(spark, path)
    tasks = found.agg(F.coalesce(F.sum(F.ceil(F.col("length") / STRETCH)), F.lit(1))).collect()[0][0]  # the places alone would all fit one task
    places = record_places(found, opener).withColumn("stretch", F.floor(F.col("at") / STRETCH))
    return places.repartition(tasks, "path", "stretch").sortWithinPartitions("path", "at").drop("stretch").mapInPandas(fetch, RECORD)


_NAMES = [x.split()[0] for x in RECORD.split(", ")]


#: DuckDB SQL for op12's rows over pages.
SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS k, first(page_id) OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS response FROM p),
h AS (SELECT *, list_transform(string_split(hex, ''), lambda c: strpos('0123456789abcdef', c) - 1) AS x FROM d)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((((x[5 * i // 4 + 1] * 16 + coalesce(x[5 * i // 4 + 2], 0)) >> (3 - 5 * i % 4)) & 31) + 1)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN response END AS refers_to FROM h
"""
