"""Byte-level BPE by longest matches and adjacent-token compatibility.

A piece's BPE tokens are the only split of it whose neighbours are compatible:
two tokens are compatible when the merges of their joined bytes give those two
again.  So the longest token is tried at each place and given up for a shorter
one, or for another one before it, where a pair isn't compatible; a place from
which the rest failed is never tried again, which keeps the work linear.  All
tokens that start at a place come from one pass of an Aho-Corasick automaton over
the reversed piece, its bytes written as Latin-1 characters.

Edge cases: a null or empty text has no ids and decodes to no bytes; rows are
independent, so repeated rows and null ids keep theirs; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessella.llm import arrays, tokens

PAIRS = 500_000  # remembered pairs per worker
STRETCHES = 500_000  # remembered stretches per worker


class Vocabulary:
    """Encode and decode by the ranks of byte strings."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.length = {r: len(t) for t, r in ranks.items()}
        self.token = {r: t for t, r in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token[::-1].decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}  # by left + 1 and right in one number
        size = max(ranks.values(), default=-1) + 1
        lengths = np.zeros(size, np.int64)
        lengths[list(self.length)] = list(self.length.values())
        self.bounds = np.concatenate([[0], np.cumsum(lengths)])
        self.bytes = np.frombuffer(b"".join(self.token.get(r, b"") for r in range(size)), np.uint8)

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})

    def merges(self, text: bytes) -> list[int]:
        """Ranks by merging the lowest-ranked neighbours until none merge; for short strings."""
        ranks, parts = self.ranks, [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            found = [ranks.get(a + b, 1 << 62) for a, b in zip(parts, parts[1:], strict=False)]
            low = min(found)
            if low == 1 << 62:
                break
            at = found.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when joined; left -1: none before."""
        pair = (left + 1) << 32 | right
        found = self.pairs.get(pair)
        if found is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            want = [right] if left < 0 else [left, right]
            found = self.pairs[pair] = self.merges(b"".join(self.token[t] for t in want)) == want
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        starting: list[list[int]] = [[] for _ in range(n)]
        for end, rank in self.automaton.iter(piece[::-1].decode("latin-1")):
            starting[n - 1 - end].append(rank)  # longest first
        out: list[int] = []
        tried: list[int] = []
        dead = bytearray(n + 1)
        length, pairs, compatible = self.length, self.pairs, self.compatible
        at = choice = 0
        while at < n:
            before = out[-1] if out else -1
            for k in range(choice, len(options := starting[at])):
                token = options[k]
                if not dead[at + length[token]]:
                    fits = pairs.get((before + 1) << 32 | token)
                    if compatible(before, token) if fits is None else fits:
                        out.append(token)
                        tried.append(k)
                        at += length[token]
                        choice = 0
                        break
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte of the text")
                dead[at] = 1
                at -= length[out.pop()]
                choice = tried.pop() + 1
        return out

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids, and the byte bounds of each document."""
        size = self.bounds[ids + 1] - self.bounds[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.bytes[arrays.ragged(size, self.bounds[ids])], ends[bounds]


def _encoder(path: str) -> tokens.Tokens:
    import public_tokenizers
    import regex

    own = vocabulary(path)
    find = regex.compile(public_tokenizers.PATTERN).findall
    one = own.encode_piece

    def encode(text: str) -> list[int]:
        core = text[1:] if text[:1] == " " else text
        if core.isalpha():
            return one(text.encode("utf-8"))
        return [i for p in find(text) for i in one(p.encode("utf-8"))]

    return tokens.Tokens(lambda texts: list(map(encode, texts)), STRETCHES)


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary.from_file(path)
    return _VOCABULARIES[path]


def _binary(data: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def encode(docs: DataFrame, path: str, make: Callable[[str], tokens.Tokens] = _encoder, decoded: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids`` per document; ids as little-endian 32-bit integers.

    With ``decoded`` also the bytes that the ids decode to, by the same worker.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.of(make, path)
        for table in arrays.chunks(batches):
            ids, bounds = encoder.ids(*arrays.text_bytes(table["text"]))
            columns = [arrays.plain(table["doc_id"]), pa.array(np.diff(bounds)), _binary(ids.astype("<u4"), bounds * 4)]
            columns += [_decoded(path, columns[2])] if decoded else []
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded"][: len(columns)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary" + ", decoded binary" * decoded)


def _decoded(path: str, ids: pa.Array) -> pa.Array:
    """The bytes of every row's ids."""
    data, off = arrays.text_bytes(ids)
    return _binary(*vocabulary(path).decode(np.frombuffer(data.tobytes(), "<u4").astype(np.int64), off // 4))


def decode(coded: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` per row of ``encode``; ``decoded`` holds the text's bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch["doc_id"], batch["n_tokens"], batch["ids"], _decoded(path, batch["ids"])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded"])

    rows = coded.select("doc_id", "n_tokens", "ids")
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, decoded binary")
