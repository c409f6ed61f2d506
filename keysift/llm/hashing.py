"""64-bit hashes of Arrow strings and of numbers, in numpy."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa

_TABLE = np.random.default_rng(20170817).integers(1, 2**64, 256, np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def mixed(values: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a permutation of 64-bit numbers that spreads every bit."""
    values = values + np.uint64(0x9E3779B97F4A7C15)
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _powers(count: int) -> np.ndarray:
    made = np.full(count, _BASE, np.uint64)
    made[:1] = 1
    return np.multiply.accumulate(made)


def hash_strings(strings: pa.Array) -> np.ndarray:
    """A hash of each string, for dealing out; none may be empty or null.  Long strings that share one can be made."""
    if not len(strings):
        return np.zeros(0, np.uint64)
    wide = pa.types.is_large_string(strings.type)
    offsets = np.frombuffer(strings.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    data = np.frombuffer(strings.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    begins, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
    place = np.arange(len(data)) - np.repeat(begins, sizes)
    sums = np.add.reduceat(_TABLE[data] * _powers(int(sizes.max()))[place], begins)
    return mixed(sums ^ sizes.astype(np.uint64))


def told_apart(strings: pa.Array) -> np.ndarray:
    """Eight bytes of BLAKE2 of each string, which stand for it: no strings are known that share them.  None may be null."""
    data = strings.cast(pa.binary()).to_pylist()
    return np.frombuffer(b"".join(blake2b(x, digest_size=8).digest() for x in data), "<u8").astype(np.uint64)
