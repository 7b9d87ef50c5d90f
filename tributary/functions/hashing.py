"""Randomness as hashes of keys, so that results don't depend on partitions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(*parts) -> Column:
    return F.md5(F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]).cast("binary"))


def hash_int(*parts) -> Column:
    """32 bits as long."""
    return F.conv(F.substring(hash_key(*parts), 1, 8), 16, 10).cast("long")


def uniform(*parts) -> Column:
    """In (0, 1)."""
    return (hash_int(*parts) + 0.5) / 4294967296.0


def quick_uniform(*parts) -> Column:
    """In (0, 1), by a cheaper hash that SQL elsewhere needn't know: for draws over many rows."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    return (F.shiftrightunsigned(F.xxhash64(*columns), 12) + 0.5) / float(1 << 52)


def normal(*parts) -> Column:
    """Standard normal by Box-Muller."""
    return F.sqrt(-2.0 * F.ln(uniform(*parts, F.lit("r")))) * F.cos(2.0 * F.lit(3.141592653589793) * uniform(*parts, F.lit("a")))


_ADDS = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4


def padded(texts: list[bytes]) -> np.ndarray:
    """Rows of 56 bytes: each text and the bit that ends a message; texts of at most 55 bytes."""
    return np.stack([np.frombuffer(t + b"\x80" + bytes(55 - len(t)), np.uint8) for t in texts])


def md5_of_pairs(starts: list[bytes], ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Digests (starts by ends by 4, unsigned little-endian words) of each start with each end, by whole arrays.

    ends: padded() of the ends; lengths: of theirs. For messages of one block, at most 55 bytes.
    """
    block = np.zeros((len(starts), len(ends), 64), np.uint8)
    for r, start in enumerate(starts):
        block[r, :, : len(start)] = np.frombuffer(start, np.uint8)
        block[r, :, len(start) : 56] = ends[:, : 56 - len(start)]
        block[r, :, 56:64] = (8 * (lengths + len(start))).astype("<u8").view(np.uint8).reshape(-1, 8)
    words = np.ascontiguousarray(block.reshape(-1, 64).view("<u4").T)
    first = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(words.shape[1], x, np.uint32) for x in first)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
            g = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
            g = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
            g = (3 * i + 5) % 16
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
            g = 7 * i % 16
        f += a
        f += words[g]
        f += np.uint32(_ADDS[i])
        np.right_shift(f, np.uint32(32 - _TURNS[i]), out=t)
        np.left_shift(f, np.uint32(_TURNS[i]), out=f)
        f |= t
        f += b
        a, d, c, b, f = d, c, b, f, a
    return np.stack([x + y for x, y in zip((a, b, c, d), first)], axis=1).reshape(len(starts), len(ends), 4)
