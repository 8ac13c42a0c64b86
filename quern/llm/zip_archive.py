"""ZIP archives of stored members: written as a stream, and read by ranges through their directories, without extraction."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

#: read(offset, length) gives up to `length` bytes of an archive from `offset` on.
Read = Callable[[int, int], bytes]
#: Fixed values of the format: signatures of its records, and what stands where a number needs ZIP64.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
_LOCAL, _CENTRAL, _END = struct.Struct("<4s5H3L2H"), struct.Struct("<4s6H3L5H2L"), struct.Struct("<4s4H2LH")
_END64, _LOCATOR64 = struct.Struct("<4sQ2H2L4Q"), struct.Struct("<4sLQL")
#: 1 January 1980, so that an archive that is written again is the same.
_TIME, _DATE, _UTF8 = 0, 33, 0x800
#: Bytes of a directory that are read at once.
STEP = 1 << 20


@dataclass(frozen=True)
class Member:
    """A file in an archive: its bytes are `size` at `start` if `stored`, else compressed there."""

    name: str
    start: int
    size: int
    stored: bool


def open_ranges(uri: str) -> Read:
    """Range reads of a file on any file system that Arrow knows by its URI (file, hdfs, s3, gs, ...)."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    file = system.open_input_file(path)

    def read(offset: int, length: int) -> bytes:
        file.seek(offset)
        return file.read(length)

    return read


class ZipStream:
    """Makes an archive piece by piece. Between two pieces lie `gap` bytes that whoever writes them adds, as a text sink does
    its new lines; the last `gap` bytes are the archive's comment."""

    def __init__(self, gap: int = 0, zip64: bool = False) -> None:
        self.gap, self.zip64, self.at = gap, zip64, 0
        self.entries: list[tuple[bytes, int, int, int]] = []

    def _goes(self, piece: bytes) -> bytes:
        self.at += len(piece) + self.gap
        return piece

    def member(self, name: str, data: bytes) -> bytes:
        """A stored member of under 4 GB; where the piece begins its header does."""
        raw, crc = name.encode(), zlib.crc32(data)
        self.entries.append((raw, crc, len(data), self.at))
        return self._goes(_LOCAL.pack(LOCAL, 20, _UTF8, 0, _TIME, _DATE, crc, len(data), len(data), len(raw), 0) + raw + data)

    def directory(self) -> Iterator[bytes]:
        """The central directory and the end records, as one piece without a gap inside. Numbers that do not fit, or all if
        zip64 is asked for, go to ZIP64 fields."""
        start, parts = self.at, []
        for raw, crc, size, at in self.entries:
            wide = self.zip64 or at >= FULL32
            extra = struct.pack("<2HQ", 1, 8, at) if wide else b""
            parts.append(_CENTRAL.pack(CENTRAL, 45 if wide else 20, 45 if wide else 20, _UTF8, 0, _TIME, _DATE, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, FULL32 if wide else at) + raw + extra)
        central, n = b"".join(parts), len(self.entries)
        tail = b""
        if wide := self.zip64 or n >= FULL16 or start >= FULL32 or len(central) >= FULL32:
            tail = _END64.pack(END64, _END64.size - 12, 45, 45, 0, 0, n, n, len(central), start) + _LOCATOR64.pack(LOCATOR64, 0, start + len(central), 1)
        few, size, at = (FULL16, FULL32, FULL32) if wide else (n, len(central), start)
        yield self._goes(central + tail + _END.pack(END, 0, 0, few, few, size, at, self.gap))


def _end(read: Read, length: int) -> tuple[int, int, int]:
    """Where the central directory lies, its bytes and its entries. The end record is the last whose comment ends the file."""
    low = max(0, length - _END.size - FULL16)
    tail = read(low, length - low)
    at = len(tail)
    while (at := tail.rfind(END, 0, at)) >= 0:
        if at + _END.size <= len(tail):
            _, _, _, _, n, size, start, comment = _END.unpack_from(tail, at)
            if at + _END.size + comment == len(tail):
                break
    else:
        raise ValueError("not a ZIP archive: it has no end record")
    if FULL16 in (n,) or FULL32 in (size, start):
        place = low + at - _LOCATOR64.size
        found = read(place, _LOCATOR64.size) if place >= 0 else b""
        if found[:4] == LOCATOR64:
            _, _, place, _ = _LOCATOR64.unpack(found)
            record = read(place, _END64.size)
            if record[:4] != END64:
                raise ValueError("damaged ZIP archive: its locator leads to no ZIP64 end record")
            n, size, start = _END64.unpack(record)[-3:]
    return start, size, n


def _wide(extra: bytes, size: int, packed: int, at: int) -> tuple[int, int, int]:
    """size, packed and at of an entry, from its ZIP64 field where the entry itself has no room; the field has just those."""
    i = 0
    while i + 4 <= len(extra):
        kind, n = struct.unpack_from("<2H", extra, i)
        if kind == 1:
            values = iter(struct.unpack_from(f"<{n // 8}Q", extra, i + 4))
            return tuple(next(values) if x == FULL32 else x for x in (size, packed, at))
        i += 4 + n
    return size, packed, at


def members(read: Read, length: int) -> Iterator[Member]:
    """The members that an archive's central directory names, in its order; the directory is read STEP bytes at a time.

    Raises ValueError where the archive has no directory or is cut off. An empty archive has no members."""
    start, size, n = _end(read, length)
    held, at = b"", start
    for _ in range(n):
        need = _CENTRAL.size
        while True:
            if len(held) >= _CENTRAL.size:
                need = _CENTRAL.size + sum(_CENTRAL.unpack_from(held)[10:13])
            if len(held) >= need:
                break
            more = read(at, min(max(STEP, need), start + size - at))
            if not more:
                raise ValueError("damaged ZIP archive: its directory ends early")
            held, at = held + more, at + len(more)
        fields = _CENTRAL.unpack_from(held)
        if fields[0] != CENTRAL:
            raise ValueError("damaged ZIP archive: its directory holds something else")
        name, extra = held[_CENTRAL.size :][: fields[10]], held[_CENTRAL.size + fields[10] :][: fields[11]]
        held = held[need:]
        full, packed, place = _wide(extra, fields[9], fields[8], fields[16])
        head = read(place, _LOCAL.size)
        if head[:4] != LOCAL:
            raise ValueError(f"damaged ZIP archive: no member begins at {place}")
        yield Member(name.decode("utf-8" if fields[3] & _UTF8 else "cp437"), place + _LOCAL.size + sum(_LOCAL.unpack(head)[-2:]), packed, fields[4] == 0)
