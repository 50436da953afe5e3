"""Number arrays as one compressed binary, and ids of the row blocks that send them."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark import TaskContext


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays by byte plane, so that high bytes that hardly change cost little."""
    head = json.dumps([[a.dtype.str, len(a)] for a in arrays]).encode()
    body = [len(head).to_bytes(4, "little"), head]
    body += [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(body))


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    at = 4 + int.from_bytes(data[:4], "little")
    out = []
    for kind, n in json.loads(data[4:at]):
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * size
    return out


def block_ids() -> Iterator[int]:
    """Ids that no other task of the stage gives, and that a repeated attempt gives again."""
    context = TaskContext.get()
    k = (context.partitionId() if context else 0) << 32
    while True:
        yield k
        k += 1
