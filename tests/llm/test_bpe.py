"""Merge rounds against the tokenizers library: odd signs, long words, special strings, cut ids, and the query's digests."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from learntrail.llm import bpe

ODD = [(1, "a b c d e f"), (2, None), (3, ""), (4, "  \n\t "), (5, "word"), (6, "a b c d e f"), (7, "x" * 30_000), (8, "é ñ 日本語 😀 <|endoftext|> don't"), (None, "no id here"), (6, "a b c d e f")]
SIGNS = ["a", "b", " ", "\n", "'", "ll", "é", "1", "<|endoftext|>", "!", "the", "日", "　", "\x1c", "\x85", "\xa0", "​", "\x00", "\t", "aaaa", "=", "ſ", "٣", "́", "'S", "\r", "﻿"]


def library(special: bool = True):
    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = not special
    return found


@pytest.mark.parametrize("special", [True, False])
def test_batches_equal_the_library(special):
    rng, lib, own = random.Random(1), library(special), bpe.Encoder(special=special)
    cases = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 14))) for _ in range(2000)]
    cases += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEF") for _ in range(n)) for n in (5, 255, 256, 257, 3000) for _ in range(5)]
    cases += ["x" * 30_000, "ab" * 5000, "日本語" * 3000, "=" * 777, "'" * 5000, " " * 1000, "ha" * 200 + " " + "z" * 511]
    for begin in range(0, len(cases), 700):
        texts = cases[begin : begin + 700]
        ids, counts = own.encode(texts)
        back = bpe.decode(own.merges, ids, counts)
        for text, got, round_trip in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), back, strict=True):
            want = lib.encode(text, add_special_tokens=False).ids
            assert got.tolist() == want, text[:50]
            assert round_trip == lib.decode(want, skip_special_tokens=False)


def test_both_kinds_of_rounds_agree():
    rng, merges = random.Random(2), bpe.Merges()
    words = ["".join(rng.choice("abeinrst") for _ in range(rng.randint(1, 60))).encode() for _ in range(500)]
    lengths = np.array([len(w) for w in words])
    a, b = merges._by_word(words, lengths), merges._by_rank(words, lengths)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()
    assert merges.encode_words([])[0].tolist() == []


def test_a_full_store_is_emptied(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 5)
    own, lib = bpe.Encoder(), library()
    for text in ("one two three four five six", "seven eight <|endoftext|> nine", "one two"):
        assert own.encode([text])[0].tolist() == lib.encode(text, add_special_tokens=False).ids


def test_cut_ids_decode_like_the_library():
    rng, merges, lib = random.Random(3), bpe.Merges(), library()
    for _ in range(1000):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 9))]
        assert bpe.decode(merges, np.array(ids, np.int64), np.array([len(ids)])) == [lib.decode(ids, skip_special_tokens=False)]


def test_frames(spark):
    frame = spark.createDataFrame([(*r, "x", 5, "y") for r in ODD], "doc_id long, text string, ids string, n_tokens long, key string")
    lib = library()
    back = bpe.decode_documents(bpe.encode_documents(frame)).collect()
    got = sorted(((r.doc_id, r.ids, r.text) for r in back), key=str)
    assert got == sorted(((d, lib.encode(t or "", add_special_tokens=False).ids, t or "") for d, t in ODD), key=str)
    assert bpe.decode_documents(bpe.encode_documents(frame.limit(0))).count() == 0
    odd_ids = spark.createDataFrame([(1, None), (2, []), (3, [64, None, -5, 60_000, 65]), (4, [50256])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode_documents(odd_ids).collect()} == {1: "", 2: "", 3: lib.decode([64, 65]), 4: "<|endoftext|>"}


def test_query_equals_the_library(spark, sf_dir):
    lib = library()
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op11_bpe(spark, sf_dir).collect()} == want
