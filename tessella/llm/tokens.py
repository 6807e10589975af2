"""Token ids of whole texts, each distinct stretch of text tokenised once.

A text is cut where no match of the tokenizer's own splitting can cross: before
a single space that stands between two characters that are not white space, and
between an ASCII letter and ASCII punctuation.
The stretches of a chunk are numbered exactly, only new ones go through the
tokenizer, and the ids are put back in place with array operations.
"""

from __future__ import annotations

from codecs import charmap_decode
from collections.abc import Callable
from itertools import chain

import numpy as np

from tessella.llm import arrays

CACHE = 1_000_000  # stretches remembered per worker

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def stretches(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts of every text, and the number of each stretch's text.

    Stretch k is ``data[cuts[k]:cuts[k + 1]]``.  A cut needs a space whose
    neighbours are certainly not white space; where a multi-byte character
    might be one, there is no cut, which only makes the stretch longer.
    """
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n > 2:
        space = arrays.SPACE[data]
        # Lead bytes of white space outside ASCII, and C0 controls.
        odd_lead = (data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3)
        odd = space | (data < 0x20)
        at = np.flatnonzero(data[1:-1] == 0x20) + 1
        ok = ~odd[at - 1] & ~odd[at + 1] & ~odd_lead[at + 1]
        ok &= ~((at >= 2) & (data[at - 1] >= 0x80) & odd_lead[np.maximum(at - 2, 0)])
        ok &= ~((at >= 3) & (data[at - 1] >= 0x80) & odd_lead[np.maximum(at - 3, 0)])
        cut[at[ok]] = True
        cut[1:-1] |= _PUNCTUATION[data[1:]] & _LETTER[data[:-1]]
    cut[off] = True
    cuts = np.flatnonzero(cut)
    doc = arrays.owner(cuts[:-1], off)
    return cuts, doc


def _room(array: np.ndarray, n: int) -> np.ndarray:
    return array if n <= len(array) else np.concatenate([array, np.zeros(max(n, 2 * len(array)) - len(array), array.dtype)])


class Tokens:
    """Ids of texts by ``encode``, which maps new stretches to lists of ids."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], cache: int = CACHE):
        self.encode, self.cache = encode, cache
        self.known: dict[bytes, int] = {}
        self.clear()

    def clear(self) -> None:
        self.known.clear()
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.bounds = np.zeros(1 << 12, np.int64)  # stretch k has flat[bounds[k]:bounds[k + 1]]

    def look_up(self, distinct: list[bytes]) -> np.ndarray:
        """The place in the store of each distinct stretch."""
        if len(self.known) > self.cache:
            self.clear()
        known = self.known
        new = [w for w in distinct if w not in known]
        if new:
            ids = self.encode([w.decode("utf-8") for w in new])
            at, ends = len(known), self.used + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
            self.flat = _room(self.flat, int(ends[-1]))
            self.bounds = _room(self.bounds, at + len(new) + 1)
            self.flat[self.used : ends[-1]] = np.fromiter(chain.from_iterable(ids), np.uint32, int(ends[-1]) - self.used)
            self.bounds[at + 1 : at + 1 + len(new)] = ends
            known.update(zip(new, range(at, at + len(new)), strict=True))
            self.used = int(ends[-1])
        return np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))

    def ids(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the bounds of each text."""
        n = len(off) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        cuts, doc = stretches(data, off)
        code, distinct = arrays.coded(arrays.cut(data, cuts[:-1], cuts[1:]))
        place = self.look_up(distinct.to_pylist())
        starts = self.bounds[place]
        each = (self.bounds[place + 1] - starts)[code]
        out = self.flat[arrays.ragged(each, starts[code])]
        bounds = np.zeros(n + 1, np.int64)
        np.cumsum(np.bincount(doc, weights=each, minlength=n).astype(np.int64), out=bounds[1:])
        return out, bounds


def byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the others follow from code point 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


# How the word vocabulary splits a text, and what its white space is.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _from_file(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


def _by_piece(model, pattern: str, space: str, normal: Callable[[str], str] | None) -> Callable[[list[str]], list[list[int]]]:
    """Split, then let the vocabulary's model merge each piece.

    A stretch of one optional space and letters is one piece under either
    pattern; ``space`` is what the model sees for that space.
    """
    import regex

    find = regex.compile(pattern).findall
    shown = "".join(c for _, c in sorted(byte_chars().items()))
    merge = model.tokenize

    def piece(p: str) -> list[int]:
        text = p if p.isascii() and p.isalpha() else charmap_decode(p.encode("utf-8"), "strict", shown)[0]
        return [t.id for t in merge(text)]

    def one(text: str) -> list[int]:
        if normal:
            text = normal(text)
        core = text[1:] if text[:1] == " " else text
        if core.isalpha():
            if core.isascii():
                return [t.id for t in merge(space + core if core is not text else core)]
            return piece(text if space else core)
        found = find(text)
        return piece(found[0]) if len(found) == 1 else [i for p in found for i in piece(p)]

    return lambda texts: list(map(one, texts))


def byte_level(path: str) -> Tokens:
    """Ids by the byte-level vocabulary file at ``path``."""
    import public_tokenizers

    return Tokens(_by_piece(_from_file(path).model, public_tokenizers.PATTERN, byte_chars()[32], None))


def word_level(path: str) -> Tokens:
    """Ids by the lower-casing vocabulary file with word ends at ``path``."""
    own = _from_file(path)
    normal = own.normalizer.normalize_str

    def lower(text: str) -> str:
        return text.lower() if text.isascii() else normal(text)

    return Tokens(_by_piece(own.model, WORD_PATTERN, "", lower), CACHE // 2)


_MADE: dict[tuple, Tokens] = {}


def of(kind: Callable[[str], Tokens], path: str) -> Tokens:
    """The worker's tokenizer for a file, made once per process."""
    if (kind, path) not in _MADE:
        _MADE[kind, path] = kind(path)
    return _MADE[kind, path]
