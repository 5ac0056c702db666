"""Blocks of a BGZF file."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

# The empty block that ends a BAM file.
EOF_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
MAX_BLOCK = 65536
READ_AHEAD = 1 << 20


class BgzfError(ValueError):
    """Bytes that are not a usable BGZF block."""


class Block(NamedTuple):
    offset: int
    size: int
    data: bytes


def block_size(head: bytes) -> int:
    """Size of the block that starts with ``head``."""
    if len(head) < 18:
        raise BgzfError("Truncated BGZF header")
    if head[:3] != b"\x1f\x8b\x08" or not head[3] & 4:
        raise BgzfError("Not a BGZF/gzip block")
    extra = head[12 : 12 + int.from_bytes(head[10:12], "little")]
    if len(extra) < int.from_bytes(head[10:12], "little"):
        raise BgzfError("Need more BGZF header bytes")
    while len(extra) >= 4:
        tag, length = extra[:2], int.from_bytes(extra[2:4], "little")
        value, extra = extra[4 : 4 + length], extra[4 + length :]
        if len(value) < length:
            raise BgzfError("Malformed BGZF extra field")
        if tag == b"BC" and length == 2:
            return int.from_bytes(value, "little") + 1
    raise BgzfError("Gzip member is not BGZF (BC field missing)")


def blocks(source, start: int, file_size: int, read_ahead: int = READ_AHEAD) -> Iterator[Block]:
    """Blocks from ``start`` on, inflated one after the other.

    Bytes are fetched in pieces of ``read_ahead``, at least one block each.
    """
    step = max(read_ahead, MAX_BLOCK)
    held, held_at, at = b"", start, start
    while at < file_size:
        inside = at - held_at
        if len(held) - inside < MAX_BLOCK and held_at + len(held) < file_size:
            source.seek(held_at + len(held))
            held = held[inside:] + source.read(min(step, file_size - held_at - len(held)))
            held_at, inside = at, 0
        size = block_size(held[inside : inside + 12 + 65535])
        if at + size > file_size:
            raise BgzfError("Truncated BGZF block at end of file")
        inflater = zlib.decompressobj(31)
        try:
            data = inflater.decompress(held[inside : inside + size])
        except zlib.error as problem:
            raise BgzfError(f"Corrupt BGZF block at {at}: {problem}") from problem
        if not inflater.eof or inflater.unused_data:
            raise BgzfError(f"BGZF block at {at} does not end where its header says")
        yield Block(at, size, data)
        at += size


def window(
    source, start: int, file_size: int, max_compressed: int, max_blocks: int, max_inflated: int
) -> list[Block]:
    """Blocks from ``start`` until any limit is met or a block is empty.

    Limits are looked at before each block, so the last block may overshoot.
    """
    found: list[Block] = []
    compressed = inflated = 0
    for block in blocks(source, start, file_size, max_compressed + MAX_BLOCK):
        found.append(block)
        compressed += block.size
        inflated += len(block.data)
        full = len(found) >= max_blocks or compressed >= max_compressed or inflated >= max_inflated
        if full or not block.data:
            break
    return found


def ends_with_eof_block(source, file_size: int) -> bool:
    if file_size < len(EOF_BLOCK):
        return False
    source.seek(file_size - len(EOF_BLOCK))
    return source.read(len(EOF_BLOCK)) == EOF_BLOCK
