"""Words and word shingles of UTF-8 text as 64-bit hashes, over Arrow buffers.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``; those bytes never occur
inside a multi-byte character, so byte runs and character runs are the same.
A word's identity is 128 bits: its bytes and length up to 15 bytes, a BLAKE2b
digest beyond, so short words never collide. Hashes of words and shingles are
multilinear in that identity, with random factors drawn for each run (:func:`draw_keys`):
two different ones collide with a chance of about 2**-64 whatever the texts, and no
text can be written that makes them. Both sides of a comparison must use the same keys.
Text is hashed in segments of about a megabyte, cut between words, so working memory
doesn't depend on the batch.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
WIDTH = 5
SEGMENT = 1 << 20
PIECE = 4 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_HALF, _LOW = U64(32), U64(0xFFFFFFFF)
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U64)  # masks of the first n bytes
SHORT = 15  # bytes of a word that its identity holds as they are

# where the factors of each use begin among the keys
_WORD, _RUN, _SHORT_RUN, _COMBINED, _KEYS = 0, 10, 20, 32, 48


def draw_keys(seed: bytes | None = None) -> np.ndarray:
    """Random factors of the hashes; all tasks of a run share them."""
    return np.frombuffer(hashlib.shake_256(seed or os.urandom(32)).digest(8 * _KEYS), dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(30))
    x = x * _MIX1
    x = x ^ (x >> U64(27))
    x = x * _MIX2
    return x ^ (x >> U64(31))


def identities(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for the bytes data[start:end] of each span: themselves up to SHORT bytes, a digest beyond."""
    sizes = ends - starts
    padded = np.concatenate([data, np.zeros(16, dtype=np.uint8)])
    eight = np.ndarray(len(padded) - 7, dtype="<u8", buffer=padded, strides=(1,))
    low = eight[starts] & _FIRST[np.minimum(sizes, 8)]
    high = eight[starts + 8] & _FIRST[np.clip(sizes - 8, 0, 7)] | (np.minimum(sizes, 255).astype(U64) << U64(56))
    long = np.flatnonzero(sizes > SHORT)
    if len(long):
        view = memoryview(padded)
        digests = b"".join(hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True))
        halves = np.frombuffer(digests, dtype="<u8").reshape(-1, 2)
        low[long], high[long] = halves[:, 0], halves[:, 1] | U64(0xFF << 56)
    return low, high


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """A hash of data[start:end] for each span."""
    low, high = identities(data, starts, ends)
    parts = (low & _LOW, low >> _HALF, high & _LOW, high >> _HALF)
    lanes = []
    for k in (keys[_WORD : _WORD + 5], keys[_WORD + 5 : _WORD + 10]):
        lane = parts[0] * k[1]
        lane += k[0]
        for part, factor in zip(parts[1:], k[2:], strict=True):
            lane += part * factor
        lanes.append(lane)
    return (lanes[0] & ~_LOW) | (lanes[1] >> _HALF)


def segments(data: np.ndarray, offsets: np.ndarray, size: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Ranges of data of about ``size`` bytes that end at a document's end or behind a space."""
    lo, n = int(offsets[0]), int(offsets[-1])
    while lo < n:
        hi = min(n, lo + size)
        if hi < n:
            spaces = np.flatnonzero(SPACE[data[lo:hi]])
            behind = lo + int(spaces[-1]) + 1 if len(spaces) else lo
            document = int(offsets[np.searchsorted(offsets, hi, side="right") - 1])
            hi = max(behind, document)
            if hi <= lo:
                hi = int(offsets[np.searchsorted(offsets, lo, side="right")])
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, word starts and ends in data, and each document's first word (one more at the end).

    fold lower-cases A-Z.
    """
    hashes, starts, ends = [], [], []
    for lo, hi in segments(data, offsets):
        raw = data[lo:hi]
        space = SPACE[raw]
        cut = np.zeros(hi - lo + 1, dtype=bool)
        inner = offsets[(offsets >= lo) & (offsets <= hi)] - lo
        cut[inner] = True
        before = np.empty(hi - lo, dtype=bool)
        before[0] = True
        before[1:] = space[:-1]
        after = np.empty(hi - lo, dtype=bool)
        after[-1] = True
        after[:-1] = space[1:]
        first = np.flatnonzero(~space & (before | cut[:-1]))
        last = np.flatnonzero(~space & (after | cut[1:])) + 1
        hashes.append(span_hashes(LOWER[raw] if fold else raw, first, last, keys))
        starts.append(first + lo)
        ends.append(last + lo)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, dtype=kind)
    begin = join(starts, np.int64)
    return join(hashes, U64), begin, join(ends, np.int64), np.searchsorted(begin, offsets)


def windows(hashes: np.ndarray, width: int, keys: np.ndarray) -> np.ndarray:
    """A hash of every run of ``width`` words (runs across documents too: slice them away)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=U64)
    total = np.zeros(n, dtype=U64)
    for j in range(width):
        total += hashes[j : j + n] * (keys[_RUN + j] | U64(1))
    return mix(total)


def short_run(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The one shingle of a text with fewer words than a shingle has."""
    factors = keys[_SHORT_RUN : _SHORT_RUN + len(hashes)] | U64(1)
    return mix((hashes * factors).sum(dtype=U64)[None] + keys[_SHORT_RUN + WIDTH + len(hashes)])


def combined(rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """A hash of each row of up to four shingles."""
    factors = keys[_COMBINED : _COMBINED + rows.shape[1]] | U64(1)
    return mix((rows * factors).sum(axis=1, dtype=U64))


def document_sets(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, width: int = WIDTH) -> Iterator[np.ndarray]:
    """Each document's sorted distinct shingle hashes."""
    hashes, _, _, first = words(data, offsets, keys)
    runs = windows(hashes, width, keys)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(runs[a : b - width + 1])
        else:
            yield short_run(hashes[a:b], keys) if b > a else hashes[a:a]


def set_hash(shingles: np.ndarray) -> tuple[int, int]:
    """A 128-bit digest of a sorted set as two signed numbers; (0, 0) for the empty set."""
    if not len(shingles):
        return 0, 0
    digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True) or 1, int.from_bytes(digest[8:], "little", signed=True) or 1


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its values; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.empty(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.empty(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = PIECE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about ``limit`` bytes of text (a longer text comes alone), with the text's buffers."""
    for batch in batches:
        data, offsets = text_buffers(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            to = min(to, batch.num_rows)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def one_text(text: str | bytes | None) -> tuple[np.ndarray, np.ndarray]:
    raw = (text or "").encode() if not isinstance(text, bytes) else text
    return np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)], dtype=np.int64)
