"""Encoders, decoding, packing, id stores and token counts."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from brute import repeated_words, words
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ocelens.llm import byte_bpe, id_shards, packing, queries, token_counts
from ocelens.llm.encoders import LibraryEncoder, vocabulary
from ocelens.llm.perfect_hash import PerfectHash

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [*"ab éÜ \n\t!'s12漢😀 \x1c\x85\xa0ſİΣ", "<|endoftext|>", "  ", "\r\n", "́", "", "'S", "\x00", "﻿", "　"]
odd_texts = st.lists(st.one_of(st.sampled_from(ODD), st.characters(exclude_categories=["Cs"])), max_size=40).map("".join)
ROWS = [(0, "Ünïcode and 漢字, 123!  \n\n x"), (1, None), (2, ""), (3, "the same"), (3, "the same"), (None, "no id"), (4, "long " * 5000), (5, "<|endoftext|> in a text")]


@pytest.fixture(scope="module")
def docs(spark):
    # further columns with the names of the results
    return spark.createDataFrame([(*r, "x", 1, 2) for r in ROWS], "doc_id long, text string, ids string, n_tokens int, start int")


@pytest.fixture(scope="module")
def own():
    return byte_bpe.ByteBpe(vocabulary(RANKS), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary(RANKS).splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(encoder, text):
    return np.frombuffer(encoder.encode(text), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(text=odd_texts)
def test_byte_bpe_is_the_librarys(own, library, text):
    assert ids_of(own, text) == library.encode_ordinary(text)
    assert own.decode(ids_of(own, text)) == text.encode()


def test_byte_bpe_without_any_break(own, library):
    rng = random.Random(3)
    for n in (50, 500, 5000):
        text = "".join(rng.choice("abcdeghilnorst") for _ in range(n))
        assert ids_of(own, text) == library.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(text=odd_texts)
@pytest.mark.parametrize("path", [BYTE, WORDS])
def test_cuts_keep_the_librarys_ids(path, text):
    encoder = _encoders.setdefault(path, (LibraryEncoder(vocabulary(path)), Tokenizer.from_file(path)))
    assert ids_of(encoder[0], text) == encoder[1].encode(text, add_special_tokens=False).ids


_encoders: dict = {}


def test_encode_and_decode(docs, library, own):
    encoded = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    got = sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in encoded.join(byte_bpe.decode(encoded.dropDuplicates(["doc_id"]), RANKS, public_tokenizers.PATTERN), "doc_id", "left").where("doc_id is not null").collect()), key=repr)
    want = sorted(((d, library.encode_ordinary(t or ""), (t or "").encode()) for d, t in ROWS if d is not None), key=repr)
    assert got == want
    assert byte_bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_pieces_and_places(docs):
    tokenizer = Tokenizer.from_file(WORDS)
    cut = packing.cut(docs, WORDS, 64, 1)
    rows = [r.asDict() for r in packing.pack(cut, 64).collect()]
    want = {}
    for d, t in ROWS:
        want.setdefault(d, []).append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])
    for d, all_ids in want.items():
        mine = sorted((r["start"], bytes(r["ids"])) for r in rows if r["doc_id"] == d)
        assert mine == sorted((a, np.array(ids[a : a + 64], "<u4").tobytes()) for ids in all_ids for a in range(0, len(ids), 64))
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and r["length"] == len(r["ids"]) // 4
    by: dict = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(by) == list(range(len(by)))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    padded = packing.sequences(packing.pack(cut, 64), 64, 0).collect()
    assert len(padded) == len(by) and all(len(r.ids) == 256 for r in padded)
    assert packing.pack(cut.limit(0), 64).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_patterns_are_those_of_piece_by_piece_placing(histogram):
    packs: list[int] = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            free = [40 - used for used in packs]
            best = max(range(len(packs)), key=free.__getitem__, default=None)
            if best is None or free[best] < length:
                packs.append(length)
            else:
                packs[best] += length
    found = packing.shortest_pack_first(histogram, 40)
    assert sorted(sum(a * b for a, b in runs) for n, runs in found for _ in range(n)) == sorted(packs)
    placed: dict = {}
    for n, runs in found:
        for length, times in runs:
            placed[length] = placed.get(length, 0) + n * times
    assert placed == histogram


def test_perfect_hash():
    rng = np.random.default_rng(1)
    keys, salts = (rng.integers(0, 2**63, 5000).astype(np.uint64) for _ in range(2))
    perfect = PerfectHash.build(keys, salts)
    assert sorted(perfect.places(keys, salts).tolist()) == list(range(5000))
    assert len(perfect.bits) * 8 < 5000 * 6
    assert PerfectHash.build(keys[:0], salts[:0]).places(keys[:3], salts[:3]).tolist() == [-1, -1, -1]


def test_id_store(spark, docs, tmp_path):
    tokenizer = Tokenizer.from_file(BYTE)
    folder = str(tmp_path / "store")
    id_shards.write_store(docs, BYTE, folder, 2)
    keys = spark.createDataFrame([(d, c) for d in (*range(-1, 7), None) for c in range(3)], "doc_id long, copy long")
    got = {(r.doc_id, r.copy): (r.start, bytes(r.ids)) for r in id_shards.fetch(spark, folder, id_shards.locate(spark, folder, keys)).collect()}
    want, start, copies = {}, 0, {}
    for d, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want[d, copies.get(d, 0)] = (start, np.array(ids, "<u4").tobytes())
        copies[d] = copies.get(d, 0) + 1
        start += len(ids)
    assert got == want
    empty = str(tmp_path / "empty")
    id_shards.write_store(docs.limit(0), BYTE, empty, 2)
    assert id_shards.fetch(spark, empty, id_shards.locate(spark, empty, keys)).count() == 0


def test_counts_and_cache(spark, docs, tmp_path):
    tokenizer, cache = Tokenizer.from_file(WORDS), str(tmp_path / "cache")
    more = docs.unionByName(spark.createDataFrame([(9, " the \t same\n", "", 0, 0)], docs.schema))
    want = sorted(((d, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for d, t in [*ROWS, (9, " the \t same\n")]), key=repr)
    for run in range(2):
        assert sorted((tuple(r) for r in token_counts.count_tokens(more, WORDS, cache).collect()), key=repr) == want
        # one digest per normalised text, and the second run encodes nothing
        stored = spark.read.parquet(cache)
        assert stored.select("digest").distinct().count() == 6
        before = stored.count() if run == 0 else before
    assert stored.count() == before
    assert token_counts.count_tokens(docs.limit(0), WORDS, cache).count() == 0


def test_queries_against_the_libraries(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    tokenizer = Tokenizer.from_file(BYTE)
    start, want = 0, []
    for d, t in sorted(map(tuple, docs)):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, queries.QUERIES["op6_indexed_id_shards"](spark, sf).collect())) == want


def documents(spark):
    return sorted(tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect())


def run(spark, name):
    return queries.QUERIES[name](spark, "/root/testdata/sf0.001")


def test_op1_query(spark, library):
    sha = lambda data: hashlib.sha256(data).hexdigest()
    want = []
    for d, t in documents(spark):
        ids = library.encode_ordinary(t or "")
        want.append((d, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert sorted(map(tuple, run(spark, "op1_byte_bpe").collect())) == want


def test_op5_query(spark):
    tokenizer, rows = Tokenizer.from_file(WORDS), run(spark, "op5_histogram_packing").collect()
    mine: dict = {}
    for r in rows:
        mine.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for d, t in documents(spark):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        at = 0
        for start, length, crc, total in sorted(mine.pop(d)):
            assert start == at and total == len(ids) and crc == zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    assert not mine
    filled: dict = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert sorted(filled) == list(range(len(filled))) and max(filled.values()) <= 2048
    assert sum(filled.values()) >= 0.9 * 2048 * (len(filled) - 1)


def test_op7_query(spark):
    tokenizer, want = Tokenizer.from_file(WORDS), []
    for d, t in documents(spark):
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        want.append((d, len((t or "").encode()), n, n > 2048))
    assert sorted(map(tuple, run(spark, "op7_cached_token_counts").select("doc_id", "n_bytes", "n_tokens", "over_limit").collect())) == want


def test_op10_query(spark):
    rows = run(spark, "op10_interleaved_shards").collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == [(d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in documents(spark)]
    slots: dict = {}
    for r in rows:
        assert r.law == "rows" and r.grown_shard is None
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(slots) == list(range(40))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_op4_query(spark):
    got = {r.doc_id: r for r in run(spark, "op4_line_quality").collect()}
    for d, t in documents(spark):
        w, r = words(t), got.pop(d)
        lines = [x for x in (t or "").split("\n") if words(x)]
        repeated = repeated_words(w)
        failed = len(w) < 50 or 100 * repeated > 50 * len(w)
        base = (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeated, failed)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base
        assert not (failed and r.kept)
    assert not got
