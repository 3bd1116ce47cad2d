"""Phrase collocations against plain counting, and the HAT-trie against a Counter."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegate.llm import collocations as module
from tidegate.llm.collocations import HatTrie, _CLEANED, _words, collocations, reduced, slices
from tidegate.llm.words import word_hashes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, longest=5, most=2000):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    found = []
    for lang, f in counts.items():
        n, best = totals[lang], []
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in candidates.items():
            for i in range(len(p)):
                for j in range(i + 1, len(p) + 1):
                    if j - i < len(p):
                        inside[p[i:j]] = max(inside[p[i:j]], a)
        for p, a in candidates.items():
            if inside[p] >= a:
                continue
            cuts = [(1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(best)[:most], 1):
            found.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(found)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def invented(seed, documents=60):
    r = random.Random(seed)
    words = ["a", "the", "of", "it", "New", "York", "naïve", "日本", "x" * 300]
    parts = []
    for _ in range(documents):
        some = [r.choice(words) if r.random() < 0.8 else f"w{r.randint(0, 300)}" for _ in range(r.randint(0, 90))]
        parts.append("".join(w + r.choice([" ", " ", " ", "\t ", ". ", ",", "\n"]) for w in some))
    return parts


def test_plain_counting(spark):
    rows = [(random.Random(i).choice(["en", "fr", None, "und", ""]), t) for i, t in enumerate(invented(1))]
    rows += [("en", None), ("en", ""), ("fr", " ,. \n"), ("de", "no phrase here"), *[("en", "new York new york NEW york")] * 3]
    docs = spark.createDataFrame([(l, t, "x", 1) for l, t in rows], "lang string, text string, phrase string, n int")
    for least, longest, most in ((3, 5, 2000), (2, 4, 7), (1, 2, 50)):
        assert rows_of(collocations(docs, least, longest, most)) == plain(rows, least, longest, most)
    assert collocations(docs.limit(0)).count() == 0
    assert collocations(docs, least=10_000).count() == 0
    with pytest.raises(ValueError):
        collocations(docs, longest=1)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    expected = plain([(r.lang, r.text) for r in docs.select("lang", "text").collect()], 40)
    assert rows_of(collocations(docs, 40)) == expected and len(expected) > 100


@pytest.mark.parametrize("size", [1, 7, 50, 1000])
def test_slices_hold_each_phrase_once(monkeypatch, size):
    monkeypatch.setattr(module, "SLICE", size)
    for seed in range(5):
        data = "\n".join(invented(seed, 8)).encode().translate(_CLEANED)
        expected = Counter()
        for piece in data.split(b"\n"):
            ids = word_hashes(piece).tolist()
            expected.update(tuple(ids[i : i + 3]) for i in range(len(ids) - 2))
        found = Counter()
        for one in slices(data, 2, {}):
            for i in range(max(0, one.seen - 2), len(one.words) - 2):
                if one.pieces[i] == one.pieces[i + 2]:
                    found[tuple(one.words[i : i + 3].tolist())] += 1
        assert found == expected


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 3)), max_size=200), max_size=8), st.integers(0, 30))
def test_trie_counts_bursts_and_spills(batches, most):
    before, module.BURST = module.BURST, 4
    try:
        trie, expected, found = HatTrie(2), Counter(), Counter()
        for batch in batches:
            keys = np.array(batch, np.uint64).reshape(-1, 2) << np.uint64(60)
            expected.update(map(tuple, keys.tolist()))
            if len(keys):
                trie.add(keys)
            for run, counts in trie.spilled(most):
                assert run.tolist() == sorted(run.tolist())
                found.update(dict(zip(map(tuple, run.tolist()), counts.tolist())))
            assert trie.size <= max(most, 0) or not batch
        for run, counts in trie.spilled(0):
            found.update(dict(zip(map(tuple, run.tolist()), counts.tolist())))
        assert +found == expected and trie.size == 0
    finally:
        module.BURST = before


def test_phrases_of_one_hash(monkeypatch):
    monkeypatch.setattr(module, "mix", lambda x: np.zeros_like(x))
    keys = np.array([[1, 2], [3, 4], [1, 2], [3, 4], [1, 2]], np.uint64)
    rows, counts = reduced(keys, np.ones(5, np.int64))
    assert rows.tolist() == [[1, 2], [3, 4]] and counts.tolist() == [3, 2]


def test_words_of_one_hash_get_ids_of_their_own():
    """The other ids reach the words that they are meant for."""
    shared = int(word_hashes(b"two")[0])
    (one,) = slices(b"one two one\n", 0, {shared: {b"two": 5, b"three": 6}})
    assert one.words.tolist() == [int(word_hashes(b"one")[0]), 5, int(word_hashes(b"one")[0])]


def test_filter_size_does_not_change_results(spark, monkeypatch):
    rows = [("en", t) for t in invented(3)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(module, "LEAST_BITS", module.CHUNK)
    monkeypatch.setattr(module, "MOST_BITS", module.CHUNK)
    assert rows_of(collocations(docs, 3)) == plain(rows, 3)
    words, other_ids = _words(docs.select("lang", "text"))
    assert not other_ids and words.agg(F.sum("n")).first()[0] == plain(rows, 3)[0][6]
