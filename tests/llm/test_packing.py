"""Best-fit packing against the tokenizers library, exhaustive search and the rules of packing."""

import functools
import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidegate.llm.library_bpe import LibraryEncoder
from tidegate.llm.packing import fullest, pack, pack_documents, packing_plan
from tidegate.llm.queries import op13_best_fit_packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " \n ", "a\x1cb c", "<|endoftext|>x <|startoftext|> y", "\0 a \0b c\0", "İSTANBUL Σας ΣΑΣ",
    "é ́x y\u0085z w", "it's 'twas don't..'s", "日本語 １２ ⅷ", "<|endoftext", "a<|ENDOFTEXT|>b",
    "՘֋ x​y﻿z　q", "a" * 5000,
]


@functools.cache
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    return tokenizer


def library_ids(text):
    return library().encode(text or "", add_special_tokens=False).ids


def expected_pieces(text, size):
    ids = np.array([*library_ids(text), 1], "<u4")
    return [
        (i, at, len(ids[at : at + size]), zlib.crc32(ids[at : at + size].tobytes()))
        for i, at in enumerate(range(0, len(ids), size))
    ]


def check_packed(found, size):
    """Sequences are filled without a gap from 0 on, up to ``size``; returns their number."""
    ends = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert all(end <= size for end in ends.values())
    return len(ends)


def test_words_of_the_library():
    encoder = LibraryEncoder(open(PATH, "rb").read())
    for text in ODD:
        words = encoder.words(text)
        ids = dict(encoder.encoded(set(words)))
        assert b"".join(map(ids.get, words)) == encoder.ids(text).tobytes(), text[:40]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=9), st.integers(0, 60))
def test_fullest_is_the_best_of_all_subsets(lengths, room):
    counts = np.bincount(lengths, minlength=31).astype(np.int64)
    found = fullest(counts, room)
    assert all(0 < times <= counts[length] for length, times in found)
    best = max(
        s for n in range(len(lengths) + 1) for c in itertools.combinations(lengths, n) if (s := sum(c)) <= room
    )
    assert sum(length * times for length, times in found) == best


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 50), st.integers(1, 40)), max_size=12))
def test_every_piece_has_one_place(found):
    counts = np.zeros(51, np.int64)
    for length, times in found:
        counts[length] += times
    plan = packing_plan(counts, 50)
    length = np.repeat(np.arange(51), counts)
    number = np.concatenate([np.arange(n) for n in counts])
    if not len(length):
        return
    sequence, offset = plan.place(length, number)
    order = np.lexsort((offset, sequence))
    ends = {}
    for s, o, n in zip(sequence[order], offset[order], length[order]):
        assert o == ends.get(s, 0)
        ends[s] = o + n
    assert max(ends.values()) <= 50 and len(ends) <= 2 * counts.dot(np.arange(51)) // 50 + 1


def minimum_slack_by_hand(lengths, size):
    """Minimum bin slack, one bin after the other, over lists."""
    left, bins = sorted(lengths, reverse=True), 0
    while left:
        room, rest = size - left[0], left[1:]
        best = max(
            (c for n in range(len(rest) + 1) for c in itertools.combinations(rest, n) if sum(c) <= room), key=sum
        )
        left = list(rest)
        for x in best:
            left.remove(x)
        bins += 1
    return bins


def test_as_few_bins_as_one_by_one(spark):
    for seed in range(20):
        lengths = np.random.default_rng(seed).integers(1, 20, 10).tolist()
        counts = np.bincount(lengths, minlength=21).astype(np.int64)
        numbers = np.concatenate([np.arange(n) for n in counts])
        sequences, _ = packing_plan(counts, 20).place(np.repeat(np.arange(21), counts), numbers)
        bins = len(set(sequences.tolist()))
        assert abs(bins - minimum_slack_by_hand(lengths, 20)) <= 1 and bins >= -(-sum(lengths) // 20)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = op13_best_fit_packing(spark, sf_dir).collect()
    expected = {
        (d.doc_id, *piece) for d in docs.select("doc_id", "text").collect() for piece in expected_pieces(d.text, 4096)
    }
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found} == expected
    assert len(found) == len(expected)
    total = sum(r.length for r in found)
    assert check_packed(found, 4096) <= -(-total // 4096) + 1


def test_odd_rows(spark):
    rows = [(i, text, "x") for i, text in enumerate(ODD)] + [(None, None, "x"), (3, "one two", "x"), (3, "one two", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string")
    found = pack_documents(docs, PATH, 7).collect()
    expected = sorted(
        ((d, *piece) for d, text, _ in rows for piece in expected_pieces(text, 7)), key=repr
    )
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=repr) == expected
    check_packed(found, 7)
    assert pack_documents(docs.limit(0), PATH).count() == 0


def test_equal_lengths_and_names(spark):
    pieces = spark.range(1000).select("id", F.lit(3).cast("long").alias("length"), F.lit("a").alias("sequence_id"))
    found = pack(pieces, 10).collect()
    assert check_packed(found, 10) == 334
    with pytest.raises(ValueError):
        pack(pieces.withColumn("length", F.col("length") * 4), 10)
    with pytest.raises(ValueError):
        pack(pieces.withColumn("length", F.lit(None).cast("long")), 10)
