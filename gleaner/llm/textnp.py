"""Whole Arrow batches of texts as flat byte arrays: words and hashes at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values one after another, and the n + 1 places where values begin; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        n = max(n, 1 << 16)
        for k, base in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


#: Words of more bytes are hashed one by one.
LONG_WORD = 64


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of each byte span, eight bytes at a time, each step mixed: no structure of the bytes makes two meet."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = end - start
    out = mixed(size.astype(np.uint64))
    open_ = np.flatnonzero(size <= LONG_WORD)
    for k in range(0, LONG_WORD, 8):
        open_ = open_[size[open_] > k]
        if not len(open_):
            break
        left = np.minimum(size[open_] - k, 8).astype(np.uint64) * np.uint64(8)
        lane = eight[start[open_] + k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left))
        out[open_] = mixed(out[open_] * _BASE + lane)
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
    return out


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes, modulo 2**64, of every prefix; n + 1 values.  Texts can be made to collide: verify what they decide."""
    up, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte span [start, end); equal spans have equal hashes wherever they stand."""
    _, down = _powers(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the maximal runs of bytes other than 0x20 and 0x09 to 0x0D."""
    n = len(data)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    start = np.flatnonzero(solid & (~before | edge[:n]))
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def run_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash, modulo 2**64, of each run of n bytes."""
    _, down = _powers(len(data) + 1)
    prefix = prefix_hashes(data)
    return (prefix[n:] - prefix[:-n]) * down[: len(data) - n + 1]


def runs_hash(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive values of one owner, and each run's first index."""
    if len(values) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(values) - n + 1
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = mixed(h * np.uint64(0xD6E8FEB86659FD93) + values[k : k + m] + np.uint64(k))
    first = np.flatnonzero(owner[:m] == owner[n - 1 :])
    return h[first], first
