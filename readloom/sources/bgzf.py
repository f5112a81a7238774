"""BGZF: blocks of gzip members of at most 64 KiB, addressed by virtual offsets."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

#: The empty block that ends a file.
EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BLOCK_DATA = 65280
_HEADER = struct.Struct("<4BI2BH")


def pack(block: int, within: int) -> int:
    return block << 16 | within


def unpack(voffset: int) -> tuple[int, int]:
    return voffset >> 16, voffset & 0xFFFF


def block_size(head: bytes) -> int:
    """Size of the block whose first 18 or more bytes are head; ValueError if it is none."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        raise ValueError("not a BGZF block")
    (extra,) = struct.unpack_from("<H", head, 10)
    at, end = 12, 12 + extra
    while at + 4 <= min(end, len(head)):
        size = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"BC" and size == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    raise ValueError("BGZF block without a size")


def inflate(block: bytes) -> bytes:
    """Data of one whole block; its checksum and length are verified."""
    (extra,) = struct.unpack_from("<H", block, 10)
    data = zlib.decompress(block[12 + extra : -8], wbits=-15)
    crc, size = struct.unpack("<II", block[-8:])
    if size != len(data) or zlib.crc32(data) != crc:
        raise ValueError("BGZF block is damaged")
    return data


def deflate(data: bytes, level: int = 6) -> bytes:
    """One block of at most BLOCK_DATA bytes."""
    if len(data) > BLOCK_DATA:
        raise ValueError("too much data for a BGZF block")
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    if len(body) + 26 > 65536:  # data that deflate enlarges is stored
        packer = zlib.compressobj(0, zlib.DEFLATED, -15)
        body = packer.compress(data) + packer.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def compress(data: bytes, level: int = 6, end: bool = True) -> bytes:
    out = [deflate(data[i : i + BLOCK_DATA], level) for i in range(0, len(data), BLOCK_DATA)]
    return b"".join([*out, EOF] if end else out)


def blocks(f: BinaryIO, start: int = 0, stop: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(file offset, data) of the blocks that begin in [start, stop)."""
    f.seek(start)
    at = start
    while stop is None or at < stop:
        head = f.read(18)
        if not head:
            return
        (extra,) = struct.unpack_from("<H", head, 10) if len(head) >= 12 else (0,)
        if extra > 6:
            head += f.read(extra - 6)
        size = block_size(head)
        body = f.read(size - len(head))
        if len(head) + len(body) < size:
            raise ValueError("truncated BGZF block")
        yield at, inflate(head + body)
        at += size


def block_offsets(f: BinaryIO, size: int) -> list[int]:
    """Offsets of all blocks; reads 18 bytes of each."""
    out, at = [], 0
    while at < size:
        f.seek(at)
        out.append(at)
        at += block_size(f.read(64))
    return out


def next_block(f: BinaryIO, start: int, size: int) -> int:
    """The first offset >= start where a block begins that is followed by another one or the end; size if none.

    So a split at any byte finds its blocks without a scan of the file.
    """
    at = start
    while at < size:
        f.seek(at)
        window = f.read(1 << 17)
        i = window.find(b"\x1f\x8b\x08\x04")
        if i < 0:
            at += max(len(window) - 3, 1)
            continue
        at += i
        end, sound = at, True
        for _ in range(3):
            if end == size:
                break
            f.seek(end)
            try:
                end += block_size(f.read(64))
            except ValueError:
                sound = False
                break
            if end > size:
                sound = False
                break
        if sound:
            return at
        at += 1
    return size


def decompress(data: bytes) -> bytes:
    """All of a BGZF (or plain gzip) file's data."""
    out = []
    while data:
        member = zlib.decompressobj(wbits=31)
        out.append(member.decompress(data) + member.flush())
        if not member.eof:
            raise ValueError("truncated gzip data")
        data = member.unused_data
    return b"".join(out)


def has_eof_marker(f: BinaryIO, size: int) -> bool:
    if size < len(EOF):
        return False
    f.seek(size - len(EOF))
    return f.read() == EOF
