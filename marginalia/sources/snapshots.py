"""Binary snapshots of a vector index: vectors and their neighbour lists, big-endian, with a checksum beside them."""

from __future__ import annotations

import hashlib
import struct

MAGIC = 0x4D415247


def encode(nodes: list[tuple[int, list[float], list[list[int]]]], dim: int) -> bytes:
    """Header (magic, dimension, count), then for each node its id, its vector and its neighbours level by level."""
    out = [struct.pack(">III", MAGIC, dim, len(nodes))]
    for i, vector, levels in nodes:
        if len(vector) != dim:
            raise ValueError(f"node {i} has {len(vector)} dimensions, not {dim}")
        out.append(struct.pack(f">qH{dim}f", i, len(levels), *vector))
        out += [struct.pack(f">H{len(x)}q", len(x), *x) for x in levels]
    return b"".join(out)


def decode(data: bytes) -> tuple[int, list[tuple[int, list[float], list[list[int]]]]]:
    magic, dim, count = struct.unpack_from(">III", data)
    if magic != MAGIC or dim < 1:
        raise ValueError("not a snapshot")
    at, nodes = 12, []
    for _ in range(count):
        i, n = struct.unpack_from(">qH", data, at)
        vector = list(struct.unpack_from(f">{dim}f", data, at + 10))
        at, levels = at + 10 + 4 * dim, []
        for _ in range(n):
            (m,) = struct.unpack_from(">H", data, at)
            levels.append(list(struct.unpack_from(f">{m}q", data, at + 2)))
            at += 2 + 8 * m
        nodes.append((i, vector, levels))
    return dim, nodes


def checksum(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def verified(data: bytes, expected: str) -> tuple[int, list] | None:
    """The decoded snapshot, or None where the checksum differs."""
    return decode(data) if checksum(data) == expected else None
