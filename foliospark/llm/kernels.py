"""Vectorised byte kernels over Arrow string buffers: rolling hashes, words, shingles, sliding minima.

All work on whole Arrow buffers or on slices of bounded size, so cost is linear in bytes and memory is bounded by
SEGMENT however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from foliospark.llm.shared import Idle

SEGMENT = 1 << 17
#: Longer words than so many bytes are hashed one by one.
FAR = 128
BASE, BASE2 = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes outside [^\x00-\x2F\x3A-\x60\x7B-\x7F]; upper case counts, since A-Z is lower-cased first.
NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and the n + 1 offsets of its rows in them (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, at, data = column.buffers()
    if at is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SEGMENT) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch whose texts sum to about size bytes."""
    if not batch.num_rows:
        return
    _, off = buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + size, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _powers(key: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    n, base = key
    with np.errstate(over="ignore"):
        one = np.ones(n + 1, np.uint64)
        up, down = one.copy(), one.copy()
        up[1:] = np.uint64(base)
        down[1:] = np.uint64(pow(base, -1, 1 << 64))
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


_held = Idle(_powers)


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i in 0..n."""
    return _held((1 << max(19, int(n).bit_length()), base))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every bit (splitmix64)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def prefix(data: np.ndarray, base: int = BASE) -> np.ndarray:
    """Prefix sums of byte codes times powers of base; differences of two give a substring's hash.

    Modulo 2**64 such sums have collisions by construction from 1,024 bytes on: for strings of a bounded, smaller size.
    """
    codes = _TABLE[data]
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        codes *= powers(len(data), base)[0][: len(data)]
        np.cumsum(codes, out=out[1:])
    return out


def substring_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    """64-bit hashes of the substrings [start, end), whatever their places."""
    with np.errstate(over="ignore"):
        return mix((p[end] - p[start]) * powers(len(p), base)[1][start])


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the substrings [start, end) of any size: eight bytes at a time, each mixed in before the next."""
    out = np.zeros(len(start), np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    size = end - start
    far = np.flatnonzero(size > FAR)
    live = np.flatnonzero(size <= FAR) if len(far) else np.arange(len(start))
    at, left = start[live], size[live]
    with np.errstate(over="ignore"):
        h = mix((left.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE))
        while len(live):
            w = eight[at] & _MASK[np.minimum(left, 8)]
            h = mix(h ^ w) + np.uint64(BASE2)
            more = left > 8
            done = ~more
            out[live[done]] = h[done]
            live, at, left, h = live[more], at[more] + 8, left[more] - 8, h[more]
    if len(far):
        raw = data.tobytes()
        out[far] = [int.from_bytes(blake2b(raw[a:b], digest_size=8).digest(), "little") for a, b in zip(start[far].tolist(), end[far].tolist(), strict=True)]
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """out[i] = min(x[i : i + w]), for the len(x) - w + 1 full windows."""
    n = len(x)
    if n < w:
        return x[:0]
    if w == 1:
        return x.copy()
    pad = -n % w
    y = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]) if pad else x
    y = y.reshape(-1, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def _chunks(data: np.ndarray, outside: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about SEGMENT bytes whose ends fall outside words or between texts."""
    at, n = 0, len(data)
    while at < n:
        to = min(n, at + SEGMENT)
        if to < n:
            cut = int(starts[np.searchsorted(starts, to, side="right") - 1])
            if cut > at:
                to = cut
            else:
                gap = np.flatnonzero(outside[data[at:to]])
                while not len(gap) and to < n:  # one word longer than a chunk: go on to its end
                    to = min(n, to + SEGMENT)
                    gap = np.flatnonzero(outside[data[at:to]])
                to = at + int(gap[-1]) + 1 if len(gap) and to < n else to
                after = np.searchsorted(starts, at, side="right")
                if after < len(starts) and at < starts[after] < to:
                    to = int(starts[after])
        yield at, to
        at = to


def words(data: np.ndarray, off: np.ndarray, outside: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes not in `outside`, within texts: each word's start, end and hash."""
    found = []
    for a, b in _chunks(data, outside, off[:-1]):
        d = data[a:b]
        inside = ~outside[d]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        cuts = off[np.searchsorted(off, a) : np.searchsorted(off, b, side="right")] - a
        first, last = cuts[cuts < b - a], cuts[cuts > 0] - 1
        begin[first] = inside[first]
        end[last] = inside[last]
        s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
        found.append((s + a, e + a, word_hash(_LOWER[d] if lower else d, s, e)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def word_offsets(start: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The n + 1 places among the words where each text's words begin."""
    return np.searchsorted(start, off)


def shingles(h: np.ndarray, at: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles; with fewer words, of all of them as one."""
    s = np.zeros(max(0, len(h) - n + 1), np.uint64)
    if len(s):
        for j in range(n):
            s = s * np.uint64(BASE2) + h[j : len(h) - n + 1 + j]
        s = mix(s)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(s[a : b - n + 1])
        elif b > a:
            t = b - a
            for x in h[a:b].tolist():
                t = (t * BASE2 + x) % (1 << 64)
            yield mix(np.array([t], np.uint64))
        else:
            yield s[:0]
