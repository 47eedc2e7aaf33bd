"""Number arrays in one compressed string."""

from __future__ import annotations

import struct

import numpy as np
import zstandard


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed string, byte planes apart so that small numbers take one byte."""
    head = struct.pack("<I", len(arrays)) + b"".join(struct.pack("<8sQ", a.dtype.str.encode(), len(a)) for a in arrays)
    planes = [a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in map(np.ascontiguousarray, arrays)]
    return zstandard.compress(head + b"".join(planes), 1)


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.decompress(blob)
    (count,) = struct.unpack_from("<I", data)
    at, out = 4 + 16 * count, []
    for i in range(count):
        kind, n = struct.unpack_from("<8sQ", data, 4 + 16 * i)
        dtype = np.dtype(kind.rstrip(b"\0").decode())
        planes = np.frombuffer(data, np.uint8, n * dtype.itemsize, at).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dtype) if n else np.zeros(0, dtype))
        at += n * dtype.itemsize
    return out
