"""Token ids of whole texts through a tokenizer file, with each distinct pre-token encoded once.

Byte-pair encoding never merges across pre-tokens, so the ids of a text are the ids of its
pre-tokens in order.  Texts of ASCII and Latin-1 letters are cut by vectorised byte classes; other
texts go to the library whole.  ``tests/llm/test_tokens.py`` holds the cut against the library.
"""

from __future__ import annotations

import os

import numpy as np

from . import textbytes as tb

#: Distinct pre-tokens kept by one worker; beyond that the table starts anew.
CACHE_ENTRIES = 1_200_000
CHUNK_BYTES = 1 << 20

LETTER, DIGIT, OTHER, SPACE, BLANK = range(5)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), 0xC3]] = LETTER
_CLASS[0x30:0x3A] = DIGIT
_CLASS[0x20] = SPACE
_CLASS[[0x09, 0x0A, 0x0D]] = BLANK
#: Bytes that send a text to the library: controls, the apostrophe (contractions), non-Latin-1.
_ODD_BYTE = np.zeros(256, bool)
_ODD_BYTE[[*range(0, 9), 0x0B, 0x0C, *range(0x0E, 0x20), 0x27, 0x7F, *range(0xC0, 0xC3), *range(0xC4, 0x100)]] = True
_FOLD = tb.LOWER.copy()
_FOLD[0x80:0x9F] += 0x20  # after 0xC3: capital Latin-1 letters


def plain_rows(offs: np.ndarray, buf: np.ndarray) -> np.ndarray:
    """Rows whose pre-tokens the byte classes give."""
    bad = _ODD_BYTE[buf]
    lead = np.flatnonzero(buf[:-1] == 0xC3)
    bad[lead[(buf[lead + 1] == 0x97) | (buf[lead + 1] == 0xB7)]] = True
    mark = np.flatnonzero(buf[:-1] == 0x3C)
    bad[mark[buf[mark + 1] == 0x7C]] = True  # "<|" may begin a special token
    plain = np.ones(len(offs) - 1, bool)
    plain[np.searchsorted(offs, np.flatnonzero(bad), "right") - 1] = False
    return plain


def byte_level_cuts(offs: np.ndarray, buf: np.ndarray) -> np.ndarray:
    """First bytes of the pre-tokens: runs of one class, each with one space before it."""
    kind = _CLASS[buf]
    blank = kind >= SPACE
    cut = np.empty(len(buf), bool)
    cut[0] = True
    cut[1:] = np.where(blank[1:], ~blank[:-1], (kind[1:] != kind[:-1]) & (kind[:-1] != SPACE))
    begins = offs[:-1][np.diff(offs) > 0]
    before_word = np.zeros(len(buf), bool)
    before_word[:-1] = blank[:-1] & ~blank[1:]
    before_word[begins[1:] - 1] = False
    cut |= before_word
    cut[begins] = True
    return np.flatnonzero(cut)


def word_level_cuts(offs: np.ndarray, buf: np.ndarray) -> np.ndarray:
    """First bytes of runs of letters, single digits, runs of other characters, and blanks."""
    kind = np.minimum(_CLASS[buf], SPACE)
    cut = np.empty(len(buf), bool)
    cut[0] = True
    cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    cut[offs[:-1][np.diff(offs) > 0]] = True
    return np.flatnonzero(cut)


class IdTable:
    """Ids of distinct pre-tokens by their hash: sorted arrays, no Python object per entry."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.keys = np.zeros(0, np.uint64)
        self.slots = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.slots[at], -1)

    def add(self, keys: np.ndarray, ids: list) -> np.ndarray:
        """Slots of new keys, which are sorted."""
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.concatenate([np.asarray(x, np.uint32) for x in ids]) if len(ids) else self.flat[:0]
        slots = len(self.starts) + np.arange(len(keys))
        self.starts = np.append(self.starts, len(self.flat) + np.cumsum(counts) - counts)
        self.counts = np.append(self.counts, counts)
        self.flat = np.append(self.flat, flat)
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.slots = np.insert(self.slots, at, slots)
        return slots


class Encoder:
    """Ids of the rows of a string column.  ``pieces`` encodes pre-tokens, ``whole`` a whole text."""

    def __init__(self, pieces, whole, cuts=byte_level_cuts, fold: bool = False, keep_blanks: bool = True):
        self.pieces, self.whole, self.cuts = pieces, whole, cuts
        self.fold, self.keep_blanks = fold, keep_blanks
        self.table = IdTable()

    def rows(self, column):
        """Yield (first row, offsets of ids, ids) for runs of rows."""
        for lo, offs, buf in tb.slices(column, CHUNK_BYTES):
            yield (lo, *self.run(offs, buf))

    def run(self, offs: np.ndarray, buf: np.ndarray):
        n = len(offs) - 1
        if not len(buf):
            return np.zeros(n + 1, np.int64), np.zeros(0, np.uint32)
        plain = plain_rows(offs, buf)
        if self.fold:
            folded = _FOLD[buf]
        else:
            folded = buf
        starts = self.cuts(offs, buf)
        ends = np.append(starts[1:], len(buf))
        row = np.searchsorted(offs, starts, "right") - 1
        keep = plain[row]
        if not self.keep_blanks:
            keep &= _CLASS[buf[starts]] < SPACE
        starts, ends, row = starts[keep], ends[keep], row[keep]
        counts, ids = self.look_up(folded, starts, ends)
        per_row = np.bincount(row, weights=counts, minlength=n).astype(np.int64) if len(row) else np.zeros(n, np.int64)
        if plain.all():
            return np.concatenate([[0], np.cumsum(per_row)]), ids
        out, at = [], np.concatenate([[0], np.cumsum(per_row)])
        for i in range(n):
            if plain[i]:
                out.append(ids[at[i] : at[i + 1]])
            else:
                out.append(np.asarray(self.whole(buf[offs[i] : offs[i + 1]].tobytes().decode()), np.uint32))
        return np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64), np.concatenate(out)

    def look_up(self, buf, starts, ends):
        """(ids per span, all ids in order)."""
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        keys, first, where = np.unique(tb.span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        if len(self.table.keys) > CACHE_ENTRIES:
            self.table.clear()
        slots = self.table.look_up(keys)
        new = np.flatnonzero(slots < 0)
        if len(new):
            text = buf.tobytes()
            spans = [text[s:e] for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
            slots[new] = self.table.add(keys[new], self.pieces(spans))
        slots = slots[where]
        counts = self.table.counts[slots]
        total = int(counts.sum())
        skip = np.cumsum(counts) - counts
        at = np.repeat(self.table.starts[slots] - skip, counts) + np.arange(total)
        return counts, self.table.flat[at]


def library_encoder(path: str, word_level: bool = False) -> Encoder:
    """An encoder whose ids all come from the tokenizers library."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()

    def pieces(spans):
        return [e.ids for e in tok.encode_batch_fast([s.decode() for s in spans], add_special_tokens=False)]

    def whole(text):
        return tok.encode(text, add_special_tokens=False).ids

    if word_level:
        return Encoder(pieces, whole, word_level_cuts, fold=True, keep_blanks=False)
    return Encoder(pieces, whole)


_encoders: dict = {}


def encoder(path: str, make=library_encoder, **options) -> Encoder:
    """One encoder per worker process and file."""
    key = (path, make.__name__, *sorted(options.items()))
    if key not in _encoders:
        _encoders[key] = make(path, **options)
    return _encoders[key]
