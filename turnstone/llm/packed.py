"""Arrays of unsigned integers as compact bytes, for rows that carry a block of them through a shuffle."""

from __future__ import annotations

import numpy as np
import zstandard


def packed(*arrays: np.ndarray) -> bytes:
    """Each array in the narrowest type that holds it, its bytes by significance, so that leading zeros compress away."""
    head, body = [len(arrays)], []
    for a in arrays:
        kind = np.min_scalar_type(int(a.max())) if len(a) else np.dtype("u1")
        head += [len(a), kind.itemsize]
        body.append(np.ascontiguousarray(a.astype(f"<u{kind.itemsize}")).view(np.uint8).reshape(len(a), kind.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(np.array(head, "<i8").tobytes() + b"".join(body))


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n = int(raw[:8].view("<i8")[0])
    at, head, out = 8 * (2 * n + 1), raw[8 : 8 * (2 * n + 1)].view("<i8").reshape(n, 2), []
    for length, width in head.tolist():
        out.append(np.ascontiguousarray(raw[at : at + length * width].reshape(width, length).T).view(f"<u{width}").reshape(length).astype(np.uint64))
        at += length * width
    return out


def steps(ordered: np.ndarray) -> np.ndarray:
    """Differences of neighbours in an ascending array (the first from zero); np.cumsum gives it back."""
    return np.diff(ordered, prepend=ordered.dtype.type(0))
