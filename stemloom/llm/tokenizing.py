"""Encoding of whole texts with a public tokenizer through a bounded table of known words.

The vocabulary's pre-tokenizer cuts a text into runs of letters, single digits, runs of other
signs and English contractions, and drops white space; each piece is encoded on its own. Texts
of ASCII and Latin-1 letters are cut here with numpy, over many texts at once, and each piece is
looked up by its 64-bit hash in a table of pieces that this process has met; only new pieces go
through the merges. Any other text goes to the tokenizer whole. Both give the tokenizer's ids.

The table is emptied when it holds ``KNOWN_PIECES`` pieces, so memory stays bounded whatever
the vocabulary of the corpus.
"""

from __future__ import annotations

import json

import numpy as np
from tokenizers import Tokenizer

KNOWN_PIECES = 2_000_000
#: Bytes that are cut at once.
BLOCK = 1 << 20
#: The pre-tokenizer whose pieces ``_cut`` finds.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_SPACE, _LETTER, _DIGIT, _OTHER, _BAD = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[:32] = _BAD
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[127] = _BAD
_KIND[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = _LETTER
_KIND[list(b"0123456789")] = _DIGIT
_KIND[0x80:0xC0] = _LETTER
_KIND[0xC0:] = _BAD
_KIND[0xC3] = _LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, base, np.uint64))])


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The printable letters by which byte-level vocabularies write bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """``encode(texts)`` gives each text's ids as little-endian bytes of ``dtype``.

    Null texts count as empty and have no ids. Special tokens written in a text are read as the
    tokenizer reads them."""

    def __init__(self, vocabulary: str):
        self.tokenizer = Tokenizer.from_file(vocabulary)
        spec = json.loads(self.tokenizer.to_str())
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        folds = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
        #: Whether ``_cut`` finds this tokenizer's pieces.
        self.cuts = folds == ["NFC", "Replace", "Lowercase"] and len(steps) == 2 and steps[0].get("pattern") == {"Regex": _PATTERN}
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.letters = _byte_letters()
        self.power, self.inverse = _powers(_P, 2 * BLOCK), _powers(pow(_P, -1, 1 << 64), 2 * BLOCK)
        self._clear()

    def _clear(self) -> None:
        self.bits = 16
        self.keys, self.slots = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.n, self.used = 0, 0
        self.at, self.size = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int32)
        self.pool = np.zeros(1 << 17, self.dtype)

    # The table: open addressing, probed for many keys at once.

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's piece, -1 for unknown ones."""
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.keys[slot]
        out = np.where(there == keys, self.slots[slot], np.int32(-1))
        left = np.flatnonzero((there != keys) & (there != 0))
        mask = (1 << self.bits) - 1
        while len(left):
            slot[left] = (slot[left] + 1) & mask
            there = self.keys[slot[left]]
            hit = there == keys[left]
            out[left[hit]] = self.slots[slot[left[hit]]]
            left = left[~hit & (there != 0)]
        return out

    def _place(self, keys: np.ndarray, pieces: np.ndarray) -> None:
        slot, left = (keys >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(keys))
        mask = (1 << self.bits) - 1
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]] = keys[free]
            done = self.keys[slot[left]] == keys[left]
            self.slots[slot[left[done]]] = pieces[left[done]]
            left = left[~done]
            slot[left] = (slot[left] + 1) & mask

    def _add(self, keys: np.ndarray, ids: list[list[int]]) -> None:
        sizes = np.array([len(x) for x in ids], np.int32)
        flat = np.array([i for x in ids for i in x], self.dtype)
        n, used = self.n + len(ids), self.used + len(flat)
        while n > len(self.at):
            self.at, self.size = np.append(self.at, self.at), np.append(self.size, self.size)
        while used > len(self.pool):
            self.pool = np.append(self.pool, self.pool)
        self.at[self.n : n] = self.used + np.cumsum(sizes) - sizes
        self.size[self.n : n] = sizes
        self.pool[self.used : used] = flat
        if 2 * n > len(self.keys):
            full = np.flatnonzero(self.keys)
            old, pieces = self.keys[full], self.slots[full]
            while 2 * n > 1 << self.bits:
                self.bits += 2
            self.keys, self.slots = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._place(old, pieces)
        self._place(keys, np.arange(self.n, n, dtype=np.int32))
        self.n, self.used = n, used

    def _cut(self, low: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces; the last byte must be white space."""
        start = np.empty(len(low), bool)
        start[0] = kind[0] != _SPACE
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start |= kind == _DIGIT
        start &= kind != _SPACE
        for i in np.flatnonzero((low == 39) & start).tolist():
            after = low[i + 1 : i + 3].tobytes()
            n = 2 if after[:1] in (b"s", b"t", b"m", b"d") else 3 if after in (b"re", b"ve", b"ll") else 0
            if n:
                start[i + 1] = False
                start[i + n] = kind[i + n] != _SPACE
        end = start[1:] | (kind[1:] == _SPACE)
        end &= kind[:-1] != _SPACE
        return np.flatnonzero(start), np.flatnonzero(end) + 1

    def _block(self, texts: list[bytes]) -> list[bytes]:
        raw = b"\n".join([*texts, b""])
        data = np.frombuffer(raw, np.uint8)
        ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
        kind = _KIND[data]
        low = _LOWER[data]
        lead = data == 0xC3
        second = np.empty_like(lead)
        second[0], second[1:] = False, lead[:-1]
        upper = second & (data < 0x9F)
        low[upper] += 32
        bad = (kind == _BAD) | ((data >= 0x80) & (data < 0xC0) & ~second) | (second & ((data == 0x97) | (data == 0xB7)))
        slow: set[int] = set()
        if bad.any():
            slow.update(np.unique(np.searchsorted(ends, np.flatnonzero(bad), "right")).tolist())
        slow.update(i for i, t in enumerate(texts) for s in self.special if s in t)
        kind[kind == _BAD] = _OTHER
        starts, stops = self._cut(low, kind)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(low) + 1, np.uint64)
            np.cumsum(_VALUE[low] * self.power[: len(low)], out=sums[1:])
            keys = (sums[stops] - sums[starts]) * self.inverse[starts] + (stops - starts).astype(np.uint64)
            keys ^= keys >> np.uint64(29)
            keys *= np.uint64(0xBF58476D1CE4E5B9)
            keys |= np.uint64(1)
        found = self._find(keys)
        new = np.flatnonzero(found < 0)
        if len(new):
            fresh, first = np.unique(keys[new], return_index=True)
            flat, letters, model = low.tobytes(), self.letters, self.tokenizer.model
            ids = []
            for i in new[first].tolist():
                word = flat[starts[i] : stops[i]].decode("latin-1").translate(letters)
                ids.append([t.id for t in model.tokenize(word)])
            self._add(fresh, ids)
            found[new] = self._find(keys[new])
        sizes = self.size[found]
        upto = np.cumsum(sizes, dtype=np.int64)
        n = int(upto[-1]) if len(upto) else 0
        where = np.repeat(self.at[found] - (upto - sizes), sizes) + np.arange(n)
        ids = self.pool[where].tobytes()
        pieces = np.searchsorted(starts, ends)
        cuts = [0, *np.where(pieces > 0, upto[pieces - 1] if n else 0, 0).tolist()]
        w = self.dtype.itemsize
        out = [ids[a * w : b * w] for a, b in zip(cuts, cuts[1:])]
        for i, e in zip(slow, self.tokenizer.encode_batch([texts[i].decode() for i in slow], add_special_tokens=False)):
            out[i] = np.array(e.ids, self.dtype).tobytes()
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.cuts:
            found = self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
            return [np.array(e.ids, self.dtype).tobytes() for e in found]
        out: list[bytes] = []
        block: list[bytes] = []
        held = 0
        for text in texts:
            raw = (text or "").encode()
            if held and held + len(raw) > BLOCK:
                out += self._block(block)
                block, held = [], 0
            if self.n > KNOWN_PIECES:
                self._clear()
            if len(raw) > BLOCK:  # a very long text alone, as far as the tables of powers reach
                if held:
                    out += self._block(block)
                    block, held = [], 0
                out.append(self._long(raw))
                continue
            block.append(raw)
            held += len(raw) + 1
        return out + (self._block(block) if block else [])

    def _long(self, raw: bytes) -> bytes:
        """A text longer than a block: cut at ASCII blanks, across which no piece reaches."""
        out, at = [], 0
        while at < len(raw):
            to = min(at + BLOCK, len(raw))
            if to < len(raw):
                blank = max(raw.rfind(b" ", at, to), raw.rfind(b"\n", at, to))
                if blank <= at:
                    rest = self.tokenizer.encode(raw[at:].decode(), add_special_tokens=False)
                    return b"".join([*out, np.array(rest.ids, self.dtype).tobytes()])
                to = blank
            out += self._block([raw[at:to]])
            at = to
        return b"".join(out)


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """This process's encoder for a vocabulary file, which must exist on every machine."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def forget(vocabulary: str) -> None:
    """Drop this process's encoder for a vocabulary file: its tables are some 85 MB, or more with many pieces, which a worker would keep."""
    _encoders.pop(vocabulary, None)
