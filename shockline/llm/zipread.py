"""Random access to stored members of ZIP packages, with ZIP64, and a writer of such packages.

Only ``read(offset, length)`` is asked for, so a package may lie in memory, in
a file or behind ranged requests.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa

END, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x01\x02", b"PK\x03\x04"
END64, LOCATOR64 = b"PK\x06\x06", b"PK\x06\x07"
BIG, SHORT = 0xFFFFFFFF, 0xFFFF


class BadPackage(ValueError):
    pass


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    crc32: int
    packed: int
    size: int
    header: int


class Package:
    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read, self.size = read, size
        try:
            self.members = {m.name: m for m in self._directory()}
        except (struct.error, UnicodeDecodeError, IndexError) as e:
            raise BadPackage("broken central directory") from e

    @classmethod
    def of(cls, body: bytes) -> "Package":
        view = memoryview(body)
        return cls(lambda offset, length: bytes(view[offset : offset + length]), len(body))

    @classmethod
    def at(cls, file: pa.NativeFile) -> "Package":
        """A package in an open file that can be sought in; only its directory is read."""
        return cls(lambda offset, length: file.read_at(length, offset), file.size())

    def _end(self) -> tuple[int, int, int]:
        """Entries, size and offset of the central directory."""
        span = min(self.size, 22 + SHORT)
        tail = self.read(self.size - span, span)
        at = tail.rfind(END)
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(END, 0, at)
        if at < 0:
            raise BadPackage("no end of central directory")
        entries, length, offset = struct.unpack_from("<HII", tail, at + 10)
        where = self.size - span + at
        if SHORT == entries or BIG in (length, offset):
            if where < 20 or (locator := self.read(where - 20, 20))[:4] != LOCATOR64:
                raise BadPackage("no ZIP64 locator")
            (end64,) = struct.unpack_from("<Q", locator, 8)
            record = self.read(end64, 56)
            if record[:4] != END64:
                raise BadPackage("no ZIP64 end of central directory")
            entries, length, offset = struct.unpack_from("<QQQ", record, 32)
        if offset + length > self.size:
            raise BadPackage("the central directory lies outside of the package")
        return entries, length, offset

    def _directory(self):
        entries, length, offset = self._end()
        body, at = self.read(offset, length), 0
        for _ in range(entries):
            if body[at : at + 4] != CENTRAL:
                raise BadPackage("broken central directory")
            flags, method, _, _, crc, packed, size, nlen, xlen, clen, _, _, _, header = struct.unpack_from("<HHHHIIIHHHHHII", body, at + 8)
            raw = body[at + 46 : at + 46 + nlen]
            extra, end = at + 46 + nlen, at + 46 + nlen + xlen
            while extra + 4 <= end:
                kind, n = struct.unpack_from("<HH", body, extra)
                if kind == 1:  # 64-bit values stand for those that are BIG, in this order
                    values = list(struct.unpack_from(f"<{n // 8}Q", body, extra + 4))
                    size = values.pop(0) if size == BIG else size
                    packed = values.pop(0) if packed == BIG else packed
                    header = values.pop(0) if header == BIG else header
                extra += 4 + n
            at = end + clen
            yield Member(raw.decode("utf-8" if flags & 0x800 else "cp437"), method, crc, packed, size, header)

    def start(self, member: Member) -> int:
        head = self.read(member.header, 30)
        if head[:4] != LOCAL or len(head) < 30:
            raise BadPackage(f"no local header of {member.name}")
        nlen, xlen = struct.unpack_from("<HH", head, 26)
        return member.header + 30 + nlen + xlen

    def range(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes lie: offset and length."""
        m = self.members.get(name)
        if m is None:
            raise BadPackage(f"no member {name}")
        if m.method != 0 or m.packed != m.size:
            raise BadPackage(f"{name} is compressed; only stored members can be read by range")
        return self.start(m), m.size

    def part(self, name: str, offset: int, length: int) -> bytes:
        begin, size = self.range(name)
        if offset < 0 or length < 0 or offset + length > size:
            raise BadPackage(f"range outside of {name}")
        return self.read(begin + offset, length)

    def lines(self, name: str, chunk: int = 1 << 20) -> Iterator[str]:
        """Lines of a stored text member, which may be a gzip file, read chunk by chunk."""
        begin, size = self.range(name)
        unpack = zlib.decompressobj(wbits=31) if name.endswith(".gz") else None
        rest = b""
        for at in range(0, size, chunk):
            body = self.read(begin + at, min(chunk, size - at))
            while body:
                if unpack is None:
                    rest, body = rest + body, b""
                else:
                    try:
                        rest += unpack.decompress(body)
                    except zlib.error as e:
                        raise BadPackage(f"{name} is no gzip file") from e
                    body = unpack.unused_data
                    if unpack.eof:  # indexes are often gzip members one after the other
                        unpack = zlib.decompressobj(wbits=31)
                *whole, rest = rest.split(b"\n")
                yield from (x.decode("utf-8", "replace").rstrip("\r") for x in whole)
        if rest:
            yield rest.decode("utf-8", "replace").rstrip("\r")


def build(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A package of stored members; ZIP64 records where sizes need them, or for all if ``zip64``."""
    out, directory = bytearray(), bytearray()
    for name, body in members:
        raw, crc, at = name.encode(), zlib.crc32(body), len(out)
        big = zip64 or len(body) >= BIG or at >= BIG
        n = BIG if big else len(body)
        extra = struct.pack("<HHQQ", 1, 16, len(body), len(body)) if big else b""
        out += LOCAL + struct.pack("<HHHHHIIIHH", 45 if big else 20, 0x800, 0, 0, 33, crc, n, n, len(raw), len(extra)) + raw + extra
        out += body
        extra = struct.pack("<HHQQQ", 1, 24, len(body), len(body), at) if big else b""
        directory += CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45 if big else 20, 45 if big else 20, 0x800, 0, 0, 33, crc, n, n, len(raw), len(extra), 0, 0, 0, 0, BIG if big else at) + raw + extra
    at, n = len(out), len(members)
    big = zip64 or at >= BIG or n >= SHORT
    out += directory
    if big:
        end64 = len(out)
        out += END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, len(directory), at)
        out += LOCATOR64 + struct.pack("<IQI", 0, end64, 1)
    out += END + struct.pack("<HHHHIIH", 0, 0, SHORT if big else n, SHORT if big else n, BIG if big else len(directory), BIG if big else at, 0)
    return bytes(out)
