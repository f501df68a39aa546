"""Compact byte strings for sorted numbers, for shuffles and index tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unsqueeze(packed: bytes) -> bytes:
    n = int.from_bytes(packed[:8], "little")
    return pa.Codec("zstd").decompress(packed[8:], decompressed_size=n, asbytes=True) if n else b""


def planes(values: np.ndarray) -> bytes:
    """Whole numbers of any size, byte plane by byte plane (a steady plane squeezes to nothing)."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    split = values.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + squeeze(np.ascontiguousarray(split).tobytes())


def unplanes(packed: bytes) -> np.ndarray:
    width = packed[0]
    split = np.frombuffer(unsqueeze(packed[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((split.shape[1], 8), np.uint8)
    out[:, :width] = split.T
    return out.view(np.uint64).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending numbers as steps."""
    values = np.asarray(values, np.uint64)
    return planes(np.diff(values, prepend=np.uint64(0)) if len(values) else values)


def unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(unplanes(packed), dtype=np.uint64)


def pack_flags(flags: np.ndarray) -> bytes:
    return squeeze(len(flags).to_bytes(8, "little") + np.packbits(flags).tobytes())


def unpack_flags(packed: bytes) -> np.ndarray:
    raw = unsqueeze(packed)
    n = int.from_bytes(raw[:8], "little")
    return np.unpackbits(np.frombuffer(raw, np.uint8, offset=8), count=n).astype(bool)
