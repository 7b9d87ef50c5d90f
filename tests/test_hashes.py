"""Hashes of pairs by whole arrays against hashlib."""

from hashlib import md5

import numpy as np

from tributary.functions.hashing import md5_of_pairs, padded


def test_digests_of_pairs_equal_hashlib():
    """F5, F12."""
    starts, ends = [b"", b"7:", b"123456789:12:", b"x" * 30], [b"", b"1:3", b"99999:42", b"y" * 25]
    got = md5_of_pairs(starts, padded(ends), np.array([len(e) for e in ends]))
    for i, s in enumerate(starts):
        for j, e in enumerate(ends):
            assert got[i, j].astype("<u4").tobytes() == md5(s + e).digest()
