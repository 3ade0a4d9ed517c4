"""A vectorised dictionary from pieces of text to their token ids.

A batch of texts is one run of bytes. It is cut before each blank or line feed where no word of the byte-level
pattern can cross, every piece of up to ``WIDEST`` bytes is loaded into four 64-bit words, and the words are
looked up in an open-addressing table by array operations. Where ``marks`` is set, it is also cut between a letter and a
punctuation mark, so a word is learned once, whatever follows it. Only pieces that the table doesn't hold, and longer
ones, are encoded, each once. Keys are compared whole, so equal hashes never confuse two pieces.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Bytes of the longest piece that the table holds; the length takes the last byte of the four words.
WIDEST = 31
#: Entries of a table; beyond it the table starts anew.
ENTRIES = 600_000

_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
_MULTIPLIERS = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]

#: For a list of pieces: all their ids in one array, and the number of ids of each.
Encode = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
#: The same for pieces that lie in one run of bytes, with their lengths.
EncodeRun = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]

#: Which bytes are ASCII letters, and which are ASCII marks other than the apostrophe, which may begin a contraction.
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_MARK = np.array([32 < b < 127 and not chr(b).isalnum() and b != 39 for b in range(256)])


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.empty(max(n, 2 * len(a)), dtype=a.dtype)
    out[: len(a)] = a
    return out


class PieceTable:
    def __init__(self, encode: Encode, specials: list[bytes], encode_run: EncodeRun | None = None, marks: bool = False, entries: int = ENTRIES):
        self.encode, self.specials, self.encode_run, self.marks, self.entries = encode, specials, encode_run, marks, entries
        self.long: dict[bytes, np.ndarray] = {}
        self._clear()

    def _clear(self) -> None:
        self.count, self.used = 0, 0
        self.keys = [np.empty(1 << 12, dtype=np.uint64) for _ in range(4)]
        self.at, self.n = np.empty(1 << 12, dtype=np.int32), np.empty(1 << 12, dtype=np.int32)
        self.flat = np.empty(1 << 14, dtype=np.uint16)
        self.slots = np.full(1 << 14, -1, dtype=np.int32)

    def _hash(self, words: list[np.ndarray]) -> np.ndarray:
        h = np.zeros(len(words[0]), dtype=np.uint64)
        for w, m in zip(words, _MULTIPLIERS, strict=True):
            h = (h ^ w) * m
            h ^= h >> np.uint64(29)
        return h * _MULTIPLIERS[0]

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def _find(self, words: list[np.ndarray], h: np.ndarray) -> np.ndarray:
        # Most are found, or have an empty slot, at once; only the others are gathered from the arrays.
        slot = self._slot(h)
        found = self.slots.take(slot).astype(np.int64)
        full = found >= 0
        hit = full.copy()
        for k, w in zip(self.keys, words, strict=True):
            hit &= k.take(found, mode="clip") == w
        found[~hit] = -1
        left = np.flatnonzero(full & ~hit)
        slot = (slot[left] + 1) & (len(self.slots) - 1)
        while len(left):
            entry = self.slots[slot]
            full = entry >= 0
            left, slot, entry = left[full], slot[full], entry[full]
            hit = np.ones(len(left), dtype=bool)
            for k, w in zip(self.keys, words, strict=True):
                hit &= k[entry] == w[left]
            found[left[hit]] = entry[hit]
            left, slot = left[~hit], (slot[~hit] + 1) & (len(self.slots) - 1)
        return found

    def _place(self, entries: np.ndarray, h: np.ndarray) -> None:
        slot = self._slot(h)
        while len(entries):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entries[free]
            lost = self.slots[slot] != entries
            entries, slot = entries[lost], (slot[lost] + 1) & (len(self.slots) - 1)

    def _add(self, words: list[np.ndarray], h: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Add new, different pieces."""
        first, n = self.count, len(h)
        self.count += n
        self.keys = [_grown(k, self.count) for k in self.keys]
        self.at, self.n = _grown(self.at, self.count), _grown(self.n, self.count)
        for k, w in zip(self.keys, words, strict=True):
            k[first : self.count] = w
        self.n[first : self.count] = counts
        self.at[first : self.count] = self.used + np.cumsum(counts) - counts
        self.flat = _grown(self.flat, self.used + len(ids))
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        if 2 * self.count > len(self.slots):
            while 2 * self.count > len(self.slots):
                self.slots = np.full(2 * len(self.slots), -1, dtype=np.int32)
            self._place(np.arange(self.count, dtype=np.int32), self._hash([k[: self.count] for k in self.keys]))
        else:
            self._place(np.arange(first, self.count, dtype=np.int32), h)

    def ids(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts ``data[bounds[i]:bounds[i + 1]]`` in order, and the number of ids of each text.

        No text may hold a special token.
        """
        size = int(bounds[-1])
        if not size:
            return np.empty(0, dtype=np.uint16), np.zeros(len(bounds) - 1, dtype=np.int64)
        padded = np.zeros(size + 40, dtype=np.uint8)
        padded[:size] = data[:size]
        starts = self._starts(padded, size, bounds, self.marks)
        lengths = np.diff(starts, append=size)
        at8 = np.ndarray((size + 32,), dtype="<u8", buffer=padded, strides=(1,))
        words = [at8[starts + 8 * k] & _MASKS[np.clip(lengths - 8 * k, 0, 8)] for k in range(4)]
        words[3] |= np.minimum(lengths, 255).astype(np.uint64) << np.uint64(56)
        h = self._hash(words)
        short = lengths <= WIDEST
        entry = self._find(words, h)
        new = np.flatnonzero((entry < 0) & short)
        if len(new):
            if self.count + len(new) > self.entries:
                self._clear()
                new = np.flatnonzero(short)
            self._learn(padded, starts, lengths, words, h, new)
            entry = self._find(words, h) if len(new) > len(h) // 2 else self._refind(entry, words, h, new)
        counts, begin = self.n[entry].astype(np.int64), self.at[entry].astype(np.int64)
        flat = self.flat
        wide = np.flatnonzero(~short)
        if len(wide):
            extra, where = [], {}
            used = self.used
            for i in wide.tolist():
                piece = padded[starts[i] : starts[i] + lengths[i]].tobytes()
                if piece not in where:
                    got = self._long(piece)
                    where[piece] = (used, len(got))
                    extra.append(got)
                    used += len(got)
                begin[i], counts[i] = where[piece]
            flat = np.concatenate([flat[: self.used], *extra])
        done = np.cumsum(counts)
        total = int(done[-1])
        out = flat[np.repeat(begin - (done - counts), counts) + np.arange(total)]
        upto = np.concatenate([[0], done])[np.searchsorted(starts, bounds)]
        return out, np.diff(upto)

    def _refind(self, entry: np.ndarray, words: list[np.ndarray], h: np.ndarray, new: np.ndarray) -> np.ndarray:
        entry[new] = self._find([w[new] for w in words], h[new])
        return entry

    def _learn(self, padded, starts, lengths, words, h, new) -> None:
        order = np.lexsort([w[new] for w in words])
        s = new[order]
        other = np.ones(len(s), dtype=bool)
        other[1:] = np.logical_or.reduce([w[s[1:]] != w[s[:-1]] for w in words])
        s = s[other]
        if self.encode_run is not None:
            ids, counts = self.encode_run(gathered(padded, starts[s], lengths[s]), lengths[s])
        else:
            raw = padded.tobytes()
            ids, counts = self.encode([raw[b:e] for b, e in zip(starts[s].tolist(), (starts[s] + lengths[s]).tolist(), strict=True)])
        self._add([w[s] for w in words], h[s], ids, counts)

    def _long(self, piece: bytes) -> np.ndarray:
        got = self.long.get(piece)
        if got is None:
            got = self.encode([piece])[0].astype(np.uint16)
            if len(self.long) > 50_000 or len(piece) > 1000:
                self.long.clear()
            self.long[piece] = got
        return got

    @staticmethod
    def _starts(padded: np.ndarray, size: int, bounds: np.ndarray, marks: bool = False) -> np.ndarray:
        """Where pieces begin: at each text, and before a blank or a single line feed between other characters.

        A character outside ASCII that might be white space never counts as a character beside a cut. With ``marks`` a piece also begins
        at a mark after a letter of ASCII or of U+00C0 to U+00FF: no word of the pattern has both.
        """
        text, after = padded[:size], padded[1 : size + 1]
        # What follows a cut must not be white space, of which those outside ASCII begin with these bytes.
        visible = (after > 32) & (after != 0xC2) & ~((after >= 0xE1) & (after <= 0xE3))
        cut = (text == 32) & visible
        cut[1:] |= (text[1:] == 10) & visible[1:] & (text[:-1] > 32) & (text[:-1] < 127)
        inside = bounds[:-1][bounds[:-1] < bounds[1:]]
        cut[inside] = True
        # The last byte of a text looks beyond its end.
        last = last_bytes(bounds)
        cut[last[~np.isin(last, inside)]] = False
        if marks:
            letter = _LETTER[text]
            # After 0xC3 come the letters U+00C0 to U+00FF, and two signs.
            letter[1:] |= (text[:-1] == 0xC3) & (text[1:] != 0x97) & (text[1:] != 0xB7)
            cut[1:] |= letter[:-1] & _MARK[text[1:]]
        return np.flatnonzero(cut)

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a column of texts (null: empty) and the number of ids of each."""
        data, bounds = utf8(column)
        odd = [i for i, t in enumerate(column) if holds(t.as_py(), self.specials)] if any(data.tobytes().find(s) >= 0 for s in self.specials) else []
        if not odd:
            return self.ids(data, bounds)
        # The library finds special tokens before it looks for words, so those texts are encoded whole.
        rows = column.to_pylist()
        whole = [self.encode([rows[i].encode()])[0].astype(np.uint16) for i in odd]
        for i in odd:
            rows[i] = ""
        ids, counts = self.ids(*utf8(pa.array(rows, pa.string())))
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for i, w in zip(odd, whole, strict=True):
            parts[i], counts[i] = w, len(w)
        return np.concatenate(parts), counts


def holds(text: str | None, specials: list[bytes]) -> bool:
    return text is not None and any(s.decode() in text for s in specials)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts in one run, and where each text begins and the last one ends."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[-1] == offsets[0]:
        return np.empty(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = 500_000):
    """Consecutive rows of a column of texts, of about ``limit`` bytes together: ``first row, rows``. Arrays over so much stay near the processor."""
    ends = utf8(column)[1][1:]
    at = 0
    while at < len(column):
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit)) + 1
        upto = min(max(upto, at + 1), len(column))
        yield at, column.slice(at, upto - at)
        at = upto


def gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of an array one after the other."""
    ends = np.cumsum(lengths)
    return data[np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]


def last_bytes(bounds: np.ndarray) -> np.ndarray:
    return bounds[1:][bounds[:-1] < bounds[1:]] - 1


class Strings:
    """A list of byte strings in one run, from which runs for arrays of indexes are gathered."""

    def __init__(self, strings: list[bytes]):
        self.flat = np.frombuffer(b"".join(strings) or b"\0", dtype=np.uint8)
        self.size = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
        self.at = np.cumsum(self.size) - self.size

    def joined(self, indexes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strings one after the other, and where each ends."""
        size = self.size[indexes]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.at[indexes] - (ends - size), size) + np.arange(total)], ends
