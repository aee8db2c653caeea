"""Arrays of keys and counts as compact binary cells, dealt out by ranges of a 64-bit hash."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(values: np.ndarray) -> bytes:
    """Little-endian bytes plane by plane, which the shuffle's compression likes for sorted keys and small counts."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def unpack(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(data, np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def squeeze(values: np.ndarray) -> bytes:
    """``pack``, and entropy-coded: for small numbers and steps between sorted keys, of which the shuffle's own compression saves whole bytes only."""
    return pa.compress(pack(values), codec="zstd", asbytes=True)


def unsqueeze(data: bytes, n: int, kind: type) -> np.ndarray:
    return unpack(pa.decompress(data, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def range_width(parts: int) -> int:
    return -(-(1 << 64) // parts)


def ranges(keys: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of the sorted keys in each hash range that holds some; linear in the keys, however many ranges there are."""
    own = keys // np.uint64(range_width(parts)) if parts > 1 else np.zeros_like(keys)
    cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(keys)]
    return [(int(own[a]), a, b) for a, b in zip(cuts, cuts[1:]) if b > a]
