"""Blocked gzip: what BAM and compressed VCF are stored in."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

#: Fixed values of the format: the empty last block, the most bytes that a block holds.
END_OF_FILE = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BLOCK = 65_280


def block(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHH", 6, b"BC", 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def packed(data: bytes) -> bytes:
    """The blocks of `data`, without the last empty one: blocks of several parts follow each other to one file."""
    return b"".join(block(data[k : k + BLOCK]) for k in range(0, len(data), BLOCK))


def compress(data: bytes) -> bytes:
    return packed(data) + END_OF_FILE


def blocks(f: BinaryIO, at: int = 0) -> Iterator[tuple[int, bytes]]:
    """(file offset, content) of each block from `at` on."""
    f.seek(at)
    while head := f.read(18):
        if len(head) < 18 or head[:2] != b"\x1f\x8b":
            raise ValueError(f"no block at {at}")
        extra = struct.unpack_from("<H", head, 10)[0]
        size = struct.unpack_from("<H", head, 16)[0] + 1
        body = f.read(size - 18)
        yield at, zlib.decompress(body[extra - 6 : -8], -15)
        at += size


class Reader:
    """Bytes from a virtual offset (block offset << 16 | place in block) on."""

    def __init__(self, f: BinaryIO, voffset: int = 0):
        self._blocks = blocks(f, voffset >> 16)
        self._skip, self._data, self._at, self._base = voffset & 0xFFFF, b"", 0, voffset >> 16

    def tell(self) -> int:
        return self._base << 16 | self._at

    def read(self, n: int) -> bytes:
        out = []
        while n > 0:
            if self._at >= len(self._data):
                got = next(self._blocks, None)
                if got is None:
                    break
                self._base, self._data = got
                self._at, self._skip = self._skip, 0
                continue
            part = self._data[self._at : self._at + n]
            self._at += len(part)
            n -= len(part)
            out.append(part)
        return b"".join(out)
