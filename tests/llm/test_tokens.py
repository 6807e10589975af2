import base64
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from tessella.llm import arrays, byte_pairs, packing, shared, simple8b, tokens

ODD = [
    "", "  a  b\n c ", "it's  'll we've", "x  y", "  z", "a  b", "a　b c", "é ǘ á", "Σ ΑΣ İstanbul ΣΑΣ Σ", "12345 1a2b ²³ ½",
    "<|endoftext|> hi <|startoftext|>x", "\x1c \x00 a \x85 b", "日本 語 テスト。 ok", "tab\t x\r\n y \n", "’s don’t a’b", "😀 😀😀 ab",
    "a _b_ __ -- -", " " * 50 + "a" + " " * 7, "ﬁ Å K ſ", "a ​ b", "e ́x", "a's.b, c; x='s", "w" * 3000,
]
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}


@pytest.fixture(scope="module")
def sample(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    return [(r.doc_id, r.text) for r in rows]


def whole(name):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(public_tokenizers.path(name))
    found.encode_special_tokens = True
    return lambda t: found.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("kind,name", [(tokens.byte_level, "byte_bpe_50k.json"), (tokens.word_level, "word_bpe_49k.json")])
def test_ids_equal_the_library(kind, name, sample):
    texts = ODD + [t for _, t in sample]
    ids, bounds = kind(public_tokenizers.path(name)).ids(*arrays.text_bytes(pa.array(texts, pa.string())))
    want = whole(name)
    for k, text in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == want(text), text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab Z'.s\n\té ́日1-", max_size=24))
def test_cuts_never_change_ids(text):
    ids, _ = tokens.of(tokens.byte_level, public_tokenizers.path("byte_bpe_50k.json")).ids(*arrays.text_bytes(pa.array([text])))
    assert ids.tolist() == whole("byte_bpe_50k.json")(text)


def test_byte_pairs_equal_tiktoken(sample):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    texts = ODD + [t for _, t in sample]
    ids, bounds = byte_pairs._encoder(public_tokenizers.path("byte_bpe_50k.tiktoken")).ids(*arrays.text_bytes(pa.array(texts, pa.string())))
    for k, text in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == own.encode_ordinary(text or ""), text


def test_pieces_equal_naive_merging():
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=RANKS, special_tokens={})
    vocabulary = byte_pairs.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    pick = random.Random(5)
    joined = list(RANKS)
    for _ in range(400):
        text = b"".join(pick.choice(joined) for _ in range(pick.randint(1, 6))).decode("utf-8", "ignore")
        if text:
            assert vocabulary.encode_piece(text.encode()) == own.encode_ordinary(text)


def test_byte_pairs_round_trip(docs):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, None), (3, "twice"), (3, "twice")]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = byte_pairs.decode(byte_pairs.encode(docs(rows).selectExpr("*", "1 as ids", "2 as n_tokens"), path), path).collect()
    assert sorted(bytes(r.decoded) for r in out) == sorted((t or "").encode() for _, t in rows)
    at_once = byte_pairs.encode(docs(rows), path, decoded=True).collect()
    assert sorted((bytes(r.ids), bytes(r.decoded)) for r in at_once) == sorted((bytes(r.ids), bytes(r.decoded)) for r in out)
    assert byte_pairs.encode(docs([]), path).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 2**16), st.integers(0, 2**64 - 1)), max_size=3000))
def test_simple8b_round_trip(values):
    ids = np.array(values, np.uint64)
    words, firsts, escapes = simple8b.pack_words(ids)
    assert np.array_equal(simple8b.unpack_words(words, firsts, len(ids), escapes), ids)
    for block, first in enumerate(firsts):
        last = firsts[block + 1] if block + 1 < len(firsts) else len(words)
        part = ids[block * simple8b.BLOCK : (block + 1) * simple8b.BLOCK]
        assert np.array_equal(simple8b.unpack_words(words[first:last], np.zeros(1, np.uint32), len(part), escapes), part)


def test_simple8b_runs_of_zeros():
    ids = np.zeros(5000, np.uint64)
    assert len(simple8b.pack_words(ids)[0]) <= 5 * 9


def test_files_hold_all_documents_in_order(spark, docs, sample, shared):
    rows = sample + [(None, None), (5, "b"), (5, "a"), (10**9, "")] + [(10**6 + k, t) for k, t in enumerate(ODD)]
    path = f"{shared}/ids-test"
    simple8b.write(docs(rows), path, public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted(simple8b.read(spark, path).collect(), key=lambda r: r.start)
    want, at = whole("byte_bpe_50k.json"), 0
    for r, (doc_id, text) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), strict=True):
        ids = np.array([*want(text), 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_no_documents_make_no_ids(spark, docs, shared):
    path = f"{shared}/no-ids"
    simple8b.write(docs([]), path, public_tokenizers.path("byte_bpe_50k.json"))
    assert simple8b.read(spark, path).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 6000), max_size=60))
def test_packing_covers_every_id_once(lengths):
    packed = packing.pack_lengths(lengths)
    seen = sorted(p for s in packed for p in s)
    at = {}
    for doc, start, length in seen:
        assert start == at.get(doc, 0) and length > 0
        at[doc] = start + length
    assert at == dict(enumerate(lengths))
    for s in packed:
        size = sum(p[2] for p in s)
        assert size <= 2048 and size & (size - 1) == 0


def test_steps_are_balanced():
    sizes = [2048] * 100 + [256] * 40 + [64, 8]
    held = np.bincount(packing.step_groups(sizes), weights=sizes)
    assert held.max() - held.min() <= 2048


def test_pieces_join_to_documents(docs, sample):
    rows = sample + [(None, None), (7, ""), (8, "x" * 30_000), (8, "x" * 30_000)]
    out = packing.pack(docs(rows).selectExpr("*", "1 as offset", "2 as tier"), public_tokenizers.path("word_bpe_49k.json")).collect()
    want = whole("word_bpe_49k.json")
    by_doc, by_sequence = {}, {}
    for r in sorted(out, key=lambda r: r.start):
        by_doc.setdefault(r.document, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert len(by_doc) == len(rows)
    got = sorted((r[0].doc_id or -1, b"".join(bytes(p.ids) for p in r)) for r in by_doc.values())
    assert got == sorted((i or -1, np.array([*want(t), 1], "<u4").tobytes()) for i, t in rows)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and len(p.ids) == 4 * p.length
            at += p.length
        assert at == pieces[0].tier <= 2048
    assert packing.pack(docs([]), public_tokenizers.path("word_bpe_49k.json")).collect() == []
