"""Token ids of whole texts by the tokenizers library, with each distinct pre-token encoded once per worker.

Both vocabularies cut a text into pre-tokens by a regular expression before any merge, so ids of a text are the ids of
its pre-tokens in order. Pre-tokens are found over character classes in numpy; a text that needs more than classes
(special tokens in it, normalisation that changes lengths, a character that this Python's Unicode tables don't know and
the library's may) goes to the library whole. A pre-token of up to seven bytes is its own key; longer ones are found by
a hash and compared by their bytes.
"""

from __future__ import annotations

import os
import unicodedata
from itertools import chain

import numpy as np
import pandas as pd

from .words import mix

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

OTHER, LETTER, NUMBER, BLANK, UNKNOWN = 0, 1, 2, 3, 4
#: Unicode White_Space.
_BLANKS = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Pre-tokens kept per worker; then the memory of them starts anew.
MEMO = 400_000

_classes: np.ndarray | None = None
_open: dict[tuple[str, str], Tokens] = {}


def classes() -> np.ndarray:
    global _classes
    if _classes is None:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.array([UNKNOWN if g == "Cn" else kinds.get(g[0], OTHER) for g in map(unicodedata.category, map(chr, range(0x110000)))], np.uint8)
        table[_BLANKS] = BLANK
        _classes = table
    return _classes


def pretokens(chars: np.ndarray, first: np.ndarray, attach: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of pre-tokens. first: marks characters that begin a text. attach: a space joins what follows it
    and blanks are tokens (else blanks are dropped and every digit is a token)."""
    n = len(chars)
    kind = classes()[chars]
    same = np.zeros(n, bool)
    same[1:] = (kind[1:] == kind[:-1]) & ~first[1:]
    start = ~same
    blank = kind == BLANK
    if attach:
        last = np.flatnonzero(blank[:-1] & ~blank[1:] & ~first[1:])  # the blank before a word
        start[last] = True
        start[last + 1] = chars[last] != 32
    else:
        start |= kind == NUMBER
    quote = np.flatnonzero((chars[:-2] == 39) & start[:-2] & (kind[1:-1] == LETTER) & ~first[1:-1]) if n > 2 else np.zeros(0, np.int64)
    if n > 1 and chars[-2] == 39 and start[-2] and kind[-1] == LETTER and not first[-1]:
        quote = np.append(quote, n - 2)
    if len(quote):
        one = chars[quote + 1]
        short = np.isin(one, [ord(c) for c in "stmd"])
        two = chars[np.minimum(quote + 2, n - 1)]
        room = (quote + 2 < n) & ~first[np.minimum(quote + 2, n - 1)]
        long = room & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))
        for hit, width in ((quote[short], 2), (quote[long], 3)):
            start[hit + 1] = False
            rest = hit + width
            rest = rest[rest < n]
            start[rest[kind[rest] == LETTER]] = True
    if attach:
        starts = np.flatnonzero(start)
        return starts, np.append(starts[1:], n)
    bounds = np.flatnonzero(start)
    ends = np.append(bounds[1:], n)
    keep = ~blank[bounds]
    return bounds[keep], ends[keep]


def known_only(text: str) -> bool:
    """Whether every character of a text has a place in this Python's Unicode tables."""
    return text.isascii() or not (classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)] == UNKNOWN).any()


_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def span_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A signed 64-bit key of each span of bytes: its bytes and length up to seven bytes, else a hash below zero."""
    eight = np.ndarray(len(data) + 1, "<u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    size = ends - starts
    keys = eight[starts] & _MASK[np.minimum(size, 8)]
    short = size < 8
    keys[short] |= size[short].astype(np.uint64) << np.uint64(56)
    long = np.flatnonzero(~short)
    h, own, at = mix(keys[long] ^ size[long].astype(np.uint64)), np.arange(len(long)), 8
    while len(own):  # eight bytes more of those that have them
        own = own[size[long[own]] > at]
        left = size[long[own]] - at
        h[own] = mix(h[own] * np.uint64(3) + (eight[starts[long[own]] + at] & _MASK[np.minimum(left, 8)]))
        at += 8
    keys[long] = h | np.uint64(1 << 63)
    return keys.view(np.int64)


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> bool:
    """Whether every span of ``size`` bytes at ``a`` equals the one at ``b``."""
    eight = np.ndarray(len(data) + 1, "<u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    at = 0
    while len(a):
        if ((eight[a + at] ^ eight[b + at]) & _MASK[np.minimum(size - at, 8)]).any():
            return False
        at += 8
        more = size > at
        a, b, size = a[more], b[more], size[more]
    return True


def byte_letters() -> dict[int, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return dict(zip(shown, shown)) | {b: 256 + k for k, b in enumerate(hidden)}


class Tokens:
    """One vocabulary in one worker."""

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.letters = byte_letters()
        self.attach = kind == "bytes"
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self._reset()

    def _reset(self) -> None:
        self.known: dict[int, int] = {}
        self.bytes: dict[int, bytes] = {}  # of keys that are hashes
        self.flat = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1, np.int64)

    def _learn(self, strings: list[str], keys: list[int]) -> None:
        """Asks the library for the ids of new pre-tokens."""
        split, letters = self.model.tokenize, self.letters
        got = [[t.id for t in split(s.encode().decode("latin-1").translate(letters))] for s in strings]
        ends = self.at[-1] + np.cumsum([len(x) for x in got])
        if ends[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), int(ends[-1]) - len(self.flat)), np.uint32)])
        self.flat[self.at[-1] : ends[-1]] = np.fromiter(chain.from_iterable(got), np.uint32, int(ends[-1] - self.at[-1]))
        base = len(self.at) - 1
        self.at = np.concatenate([self.at, ends])
        self.known.update(zip(keys, range(base, base + len(keys))))

    def _plain(self, text: str) -> bool:
        if any(s in text for s in self.special) or not known_only(text):
            return False
        if self.attach or text.isascii():
            return True
        return "Σ" not in text and "İ" not in text and unicodedata.is_normalized("NFC", text)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        whole = "".join(texts)
        if self._plain(whole):
            return self._encode(whole, texts)
        plain = [self._plain(t) for t in texts]
        some = [t for t, p in zip(texts, plain) if p]
        ids, counts = self._encode("".join(some), some)
        parts = iter(np.split(ids, np.cumsum(counts)[:-1]) if some else [])
        out = [next(parts) if p else np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32) for t, p in zip(texts, plain)]
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [self.library.encode(t, add_special_tokens=False).ids for t in texts]
        return np.fromiter(chain.from_iterable(got), np.uint32), np.array([len(x) for x in got], np.int64)

    def _encode(self, whole: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum([len(t) for t in texts]) if texts else np.zeros(0, np.int64)
        if not self.attach:
            low = whole.lower()
            if len(low) != len(whole) or not low.isascii() and not unicodedata.is_normalized("NFC", low):
                return self._whole(texts)
            whole = low
        if not whole:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        chars = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.zeros(len(chars), bool)
        first[0] = True
        first[ends[ends < len(chars)]] = True
        starts, stops = pretokens(chars, first, self.attach)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        raw = whole.encode()
        data = np.frombuffer(raw, np.uint8)
        begin, end = starts, stops
        if len(data) != len(chars):
            byte = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
            begin, end = byte[starts], byte[stops]
        codes, distinct = pd.factorize(span_keys(data, begin, end))
        seen = np.empty(len(distinct), np.int64)
        seen[codes[::-1]] = np.arange(len(codes))[::-1]
        if len(self.known) + len(distinct) > MEMO:
            self._reset()
        hashed = np.flatnonzero(distinct < 0)
        texts_of = {int(distinct[i]): raw[begin[seen[i]] : end[seen[i]]] for i in hashed}
        all_hashed = np.flatnonzero((distinct < 0)[codes])
        own = seen[codes[all_hashed]]
        size = end[all_hashed] - begin[all_hashed]
        alike = bool((size == end[own] - begin[own]).all()) and same_bytes(data, begin[all_hashed], begin[own], size)
        if not alike or any(self.bytes.get(k, v) != v for k, v in texts_of.items()):  # two pre-tokens share a hash
            return self._whole(texts)
        distinct = distinct.tolist()
        known = self.known
        new = [i for i, k in enumerate(distinct) if k not in known]
        if new:
            self._learn([whole[starts[j] : stops[j]] for j in seen[new]], [distinct[i] for i in new])
            self.bytes.update(texts_of)
        where = np.fromiter((known[k] for k in distinct), np.int64, len(distinct))
        first, count = self.at[where], (self.at[where + 1] - self.at[where])
        sizes = count[codes]
        sums = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(sizes, out=sums[1:])
        at = np.repeat(first[codes] - sums[:-1], sizes)
        at += np.arange(sums[-1])
        bounds = sums[np.searchsorted(starts, np.concatenate([[0], ends]))]
        return self.flat[at], np.diff(bounds)


def tokens(path: str, kind: str) -> Tokens:
    """The vocabulary of a file, opened once per worker. kind: bytes (blanks are kept) or words (dropped)."""
    if (path, kind) not in _open:
        _open[path, kind] = Tokens(path, kind)
    return _open[path, kind]
