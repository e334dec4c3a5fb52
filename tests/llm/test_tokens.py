"""Byte-level BPE, token files and packing against the tokenizers library."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from larder.llm import bpe, packing, token_files
from larder.llm.word_tokens import WordEncoder, vocabulary_path
from larder.session import scratch_path
from tests.llm.conftest import ROWS

PARTS = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", "12", "é", "中", "aaaa", "!", "<|endoftext|>", "\x1c", "\x85", "\xa0", "😀", "²", "the", "İ", "́", "aaa", "ß", "Word,", "WORD!!"]


def fuzz(n=3000):
    choose = random.Random(1)
    return ["".join(choose.choices(PARTS, k=choose.randint(0, 12))) for _ in range(n)]


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def expected_words(text):
    return np.array([*library("word_bpe_49k.json").encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()


def test_bpe_equals_the_library_on_odd_texts():
    codec, other = bpe.BpeCodec(bpe.default_path()), library(bpe.VOCABULARY)
    for text, found, ids in zip(fuzz(), codec.round_trip(fuzz()), codec.encode(fuzz())):
        want = other.encode(text, add_special_tokens=False).ids
        assert found == (",".join(map(str, want)).encode(), text.encode(), len(want)) and ids == want
        assert codec.decode(ids) == other.decode(want, skip_special_tokens=False)


def test_merges_overlap_from_the_left():
    ranks = bpe.PairRanks(np.array([[0, 0], [2, 2], [2, 0]]), np.array([2, 3, 4]))
    symbols, lengths = bpe.merge_all(np.array([0] * 7 + [1, 0, 0]), np.array([7, 1, 2]), ranks)
    assert symbols.tolist() == [3, 4, 1, 2] and lengths.tolist() == [2, 1, 1]


def test_merges_must_be_in_order():
    with pytest.raises(ValueError):
        bpe.PairRanks(np.array([[5, 0]]), np.array([2]))


def test_round_trip_query(documents, odd, empty):
    other = library(bpe.VOCABULARY)
    text = {r["doc_id"]: r["text"] for r in documents.collect()}
    found = bpe.round_trip_digests(documents).collect()
    assert len(found) == len(text)
    for r in found:
        ids = other.encode(text[r["doc_id"]], add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(text[r["doc_id"]]))
    assert Counter(r["doc_id"] for r in bpe.round_trip_digests(odd).collect()) == Counter(i for i, _, _ in ROWS)
    assert bpe.round_trip_digests(empty).count() == 0


def test_encode_and_decode_frames(odd):
    back = bpe.decode(bpe.encode(odd)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter((i, t or "") for i, t, _ in ROWS)


def test_word_encoder_equals_the_library():
    found = WordEncoder(vocabulary_path()).encode(fuzz())
    want = library("word_bpe_49k.json").encode_batch(fuzz(), add_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [x.ids for x in want]


def test_token_files(spark, documents):
    found = sorted(token_files.token_file_digests(documents).collect())
    start = 0
    for r, (doc, text) in zip(found, sorted((x["doc_id"], x["text"]) for x in documents.collect()), strict=True):
        ids = expected_words(text)
        assert tuple(r) == (doc, start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4


def test_token_files_of_odd_rows_and_one_document(spark, odd, empty):
    manifest = token_files.write_token_files(odd, scratch_path(spark, "files"))
    back = token_files.read_token_files(manifest).collect()
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in back) == Counter((i, expected_words(t)) for i, t, _ in ROWS)
    assert sorted(r["start"] for r in back)[0] == 0 and [r["doc_id"] for r in sorted(back, key=lambda r: r["start"])][:2] == [None, None]
    first = manifest.first()
    shard = token_files.Shard(first["path"], token_files.filesystem(first["path"])[0], {})
    assert all(shard.ids(i)[-4:] == b"\x02\0\0\0" for i in reversed(range(len(shard.docs))))
    assert token_files.token_file_digests(empty).count() == 0


def test_a_changed_dictionary_is_refused(spark, odd, tmp_path):
    first = token_files.write_token_files(odd, str(tmp_path / "files")).first()
    for file in (tmp_path / "files").glob("*.dict"):
        file.write_bytes(b"other" + file.read_bytes())
    with pytest.raises(ValueError):
        token_files.Shard(first["path"], token_files.filesystem(first["path"])[0], {})


@pytest.mark.parametrize("window", [4096, 64])
def test_packing(documents, window):
    pieces = sorted(packing.pack(documents, window).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    text = {r["doc_id"]: r["text"] for r in documents.collect()}
    at, joined = 0, {}
    for r in pieces:
        assert r["sequence_id"] * window + r["offset"] == at and 0 < r["length"] <= window - r["offset"]
        at += r["length"]
        joined.setdefault(r["doc_id"], []).append(r)
    assert joined.keys() == text.keys()
    for doc, parts in joined.items():
        parts.sort(key=lambda r: r["start"])
        ids = b"".join(bytes(r["ids"]) for r in parts)
        assert ids == expected_words(text[doc]) and {r["doc_tokens"] for r in parts} == {len(ids) // 4}


def test_packing_odd_rows(odd, empty):
    found = packing.piece_digests(packing.pack(odd, 16)).collect()
    assert sum(r["length"] for r in found) == sum(len(expected_words(t)) // 4 for _, t, _ in ROWS)
    assert {r["doc_id"] for r in found} == {i for i, _, _ in ROWS}
    assert packing.pack(empty).count() == 0
