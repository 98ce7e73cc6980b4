"""Token ids of texts by way of their distinct pieces.

The tokenizer splits a text into pre-tokens before it merges bytes, so a text's ids
are those of its pieces if every cut between pieces is also one between pre-tokens.
In byte-level BPE with the usual pattern these are: before a white-space character
that a non-space follows, where a run of white space begins, behind a white-space
character other than the blank if a non-space follows, and between an ASCII letter and
ASCII punctuation. Texts with white space outside ``[\\x20\\x09-\\x0D]`` and, unless they
are encoded as other text, with an added token's content are encoded whole. Each
distinct piece goes through the tokenizer once in a worker; the rest is array look-ups
by the piece's 128-bit identity, which is the piece itself up to 15 bytes and a BLAKE2b
digest beyond. The table starts anew at ``MOST_PIECES``.
"""

from __future__ import annotations

import re
from functools import cache
from itertools import chain

import numpy as np

from tributary.llm.shingles import SPACE, U64, identities, mix

MOST_PIECES = 1_500_000
_SLOT_BITS = 22
_LETTER, _PUNCT = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCT[33:48] = _PUNCT[58:65] = _PUNCT[91:97] = _PUNCT[123:127] = True
#: white space and separators that the rules above don't know: U+001C-1F, 85, A0, 1680, 2000-200A, 2028, 2029, 202F, 205F, 3000, also 180E and FEFF
_OTHER_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|\xef\xbb\xbf")

_SUSPECT = np.zeros(256, dtype=bool)  # bytes that such a character begins with
_SUSPECT[[*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True


def _byte_characters() -> dict[int, str]:
    """The character that byte-level BPE writes for each byte: itself where it is printable, else the next from U+0100."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in printable else next(others)) for b in range(256)}


_BYTE_CHARS = _byte_characters()


class PieceCache:
    """Encodes batches of texts with a byte-level tokenizer; encode_special: special tokens in them as other text."""

    def __init__(self, path: str, encode_special: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = encode_special
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if not (encode_special and t.special)]
        self.model = self.tokenizer.model
        self.reset()

    def reset(self) -> None:
        self.low, self.high = (np.zeros(1 << _SLOT_BITS, dtype=U64) for _ in range(2))
        self.entry = np.full(1 << _SLOT_BITS, -1, dtype=np.int32)
        self.start = np.zeros(1 << 12, dtype=np.int64)
        self.size = np.zeros(1 << 12, dtype=np.int32)
        self.ids = np.zeros(1 << 14, dtype=np.uint32)
        self.entries = self.used = 0

    def encode_text(self, raw: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(raw.decode("utf-8"), add_special_tokens=False).ids, dtype=np.uint32)

    @staticmethod
    def _slot(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (mix(low ^ mix(high)) >> U64(64 - _SLOT_BITS)).astype(np.int64)

    def _add(self, low: np.ndarray, high: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        base, n = self.entries, len(low)
        while base + n > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.size[base : base + n] = sizes
        self.start[base : base + n] = self.used + np.cumsum(sizes) - sizes
        slot = self._slot(low, high)
        left = np.arange(n)
        while len(left):
            free = left[self.entry[slot[left]] < 0]
            won = free[np.unique(slot[free], return_index=True)[1]]
            self.low[slot[won]], self.high[slot[won]], self.entry[slot[won]] = low[won], high[won], base + won
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << _SLOT_BITS) - 1)
        self.entries += n
        self.used += len(ids)

    def _encode_piece(self, piece: bytes) -> list[int]:
        """A piece's ids; one of letters only is a single pre-token, so the model alone does."""
        text = piece.decode("utf-8")
        if (text[1:] if text[0] == " " else text).isalpha():
            return [t.id for t in self.model.tokenize(piece.decode("latin-1").translate(_BYTE_CHARS))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The entry of each identity, -1 where there is none."""
        slot = self._slot(low, high)
        found = self.entry[slot]
        open_ = np.flatnonzero((found >= 0) & ((self.low[slot] != low) | (self.high[slot] != high)))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << _SLOT_BITS) - 1)
            found[open_] = self.entry[slot[open_]]
            at = slot[open_]
            open_ = open_[(found[open_] >= 0) & ((self.low[at] != low[open_]) | (self.high[at] != high[open_]))]
        return found

    def _cuts(self, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where pieces start; first: where texts start."""
        space = SPACE[data]
        cut = np.zeros(len(data), dtype=bool)
        cut[:-1] = space[:-1] & ~space[1:]
        cut[first[first > 0] - 1] = False  # a text's last byte: what follows is another text's
        cut[first] = True
        cut[1:] |= space[1:] & ~space[:-1]
        cut[1:] |= space[:-1] & ~space[1:] & (data[:-1] != 0x20)
        cut[1:] |= _LETTER[data[:-1]] & _PUNCT[data[1:]]
        return np.flatnonzero(cut)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, joined, and where each text's begin (one more at the end)."""
        raw = data.tobytes()
        if not (_SUSPECT[data].any() and _OTHER_SPACE.search(raw)) and not any(t in raw for t in self.added):
            return self._encode_cut(data, raw, offsets)
        parts = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if _OTHER_SPACE.search(raw, a, b) or any(raw.find(t, a, b) >= 0 for t in self.added):
                parts.append(self.encode_text(raw[a:b]))
            else:
                parts.append(self._encode_cut(data[a:b], raw[a:b], np.array([0, b - a]))[0])
        sizes = np.array([0, *map(len, parts)], dtype=np.int64)
        return np.concatenate(parts) if parts else np.empty(0, dtype=np.uint32), np.cumsum(sizes)

    def _encode_cut(self, data: np.ndarray, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.entries > MOST_PIECES:
            self.reset()
        if not len(data):
            return np.empty(0, dtype=np.uint32), np.zeros(len(offsets), dtype=np.int64)
        inner = offsets[:-1][offsets[:-1] < len(data)]
        cuts = self._cuts(data, inner)
        starts, ends = cuts, np.append(cuts[1:], len(data))
        low, high = identities(data, starts, ends)
        entries = self._find(low, high)
        missing = np.flatnonzero(entries < 0)
        if len(missing):
            fresh = missing[np.unique(np.stack([low[missing], high[missing]], axis=1), axis=0, return_index=True)[1]]
            if self.entries + len(fresh) > (1 << _SLOT_BITS) * 9 // 10:  # more pieces than the table holds
                self.reset()
                return self._encode_whole(raw, offsets)
            found = [self._encode_piece(raw[starts[i] : ends[i]]) for i in fresh.tolist()]
            sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            self._add(low[fresh], high[fresh], sizes, np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=int(sizes.sum())))
            entries[missing] = self._find(low[missing], high[missing])
        sizes = self.size[entries].astype(np.int64)
        until = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.start[entries] - (until - sizes), sizes) + np.arange(until[-1])]
        return ids, np.append(0, until)[np.searchsorted(starts, offsets)]

    def _encode_whole(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.encode_text(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])


@cache
def piece_cache(path: str, encode_special: bool = False) -> PieceCache:
    """One for each worker process, kept between tasks."""
    return PieceCache(path, encode_special)


@cache
def byte_table(path: str) -> list[bytes]:
    """The bytes that each id of a byte-level tokenizer stands for, special tokens by their content."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = {i: t.content.encode() for i, t in tokenizer.get_added_tokens_decoder().items()}
    byte_of = {c: b for b, c in _BYTE_CHARS.items()}
    return [added[i] if i in added else bytes(byte_of[c] for c in tokenizer.id_to_token(i) or "") for i in range(tokenizer.get_vocab_size())]
