"""Whole texts as numpy byte arrays inside a task.

A batch of texts is cut into slices of whole documents (about ``SLICE_BYTES`` each, more only
where one text alone is longer), so a task's memory follows the slice and the longest text, never
the batch. Word spans and their hashes are computed for a slice at once.

Null texts count as empty texts everywhere in this package.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def text_slices(texts: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, UTF-8 bytes, document offsets into them) of consecutive whole documents."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if n == 0:
        return
    bufs = texts.buffers()
    offs = np.frombuffer(bufs[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + max_bytes, "right")) - 1)
        last = min(last, n, first + 20_000)
        yield first, data[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
        first = last


def byte_table(chars: bytes | range) -> np.ndarray:
    """A 256-entry membership table."""
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


def space_table() -> np.ndarray:
    """The six blanks of the word rule ``[^\\x20\\x09-\\x0D]+``."""
    return byte_table(bytes([0x20, 9, 10, 11, 12, 13]))


def lower_table() -> np.ndarray:
    """Maps A-Z to a-z and every other byte to itself."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def letter_table() -> np.ndarray:
    """ASCII letters and digits, and every byte of a multi-byte character."""
    t = byte_table(bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)))
    t[128:] = True
    return t


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut at document borders."""
    n = len(mask)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = mask[:-1]
    heads = offsets[:-1]
    before[heads[heads < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = mask[1:]
    tails = offsets[1:]
    after[tails[tails > 0] - 1] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def owner(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The document (index within the slice) of each byte position."""
    return np.searchsorted(offsets, positions, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (kept per worker)."""
    up, down = _POWERS.get(base, (np.zeros(0, np.uint64), np.zeros(0, np.uint64)))
    if len(up) < n:
        size = max(n, SLICE_BYTES + 4096)
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        _POWERS[base] = (up, down)
    return up[:n], down[:n]


def prefix_hash(data: np.ndarray, base: int = BASE) -> np.ndarray:
    """Running polynomial sums; ``span_hash`` reads any span's hash from them."""
    up, _ = powers(len(data) + 1, base)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """A 64-bit hash of each span, equal for equal bytes wherever they stand."""
    _, down = powers(len(prefix), base)
    h = (prefix[ends] - prefix[starts]) * down[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) << np.uint64(40)))


def pairs_within(ids: np.ndarray, width: int) -> np.ndarray:
    """Indices i whose run i .. i+width-1 lies in one document (``ids`` non-decreasing)."""
    if len(ids) < width:
        return np.zeros(0, np.int64)
    return np.flatnonzero(ids[: len(ids) - width + 1] == ids[width - 1 :])


def triple_hash(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of the three consecutive values that begin at each place, in order."""
    if not len(at):
        return h[:0]
    return mix(mix(mix(h[at]) + h[at + 1]) + h[at + 2])


def worker_state(name: str, make):
    """One object per Python worker, kept between its tasks (a tokenizer, an opened dictionary)."""
    import sys
    import types

    kept = sys.modules.setdefault("_topicweave_worker_state", types.ModuleType("_topicweave_worker_state"))
    if not hasattr(kept, name):
        setattr(kept, name, make())
    return getattr(kept, name)
