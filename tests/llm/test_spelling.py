"""Spelling variants against plain versions: all pairs of words, and counting word by word."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegate.llm import spelling
from tidegate.llm.fm_index import Vocabulary, alphabet_of
from tidegate.llm.queries import op12_spelling_variants
from tidegate.llm.spelling import spelling_variants

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_counts(rows):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c in UPPER else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def plain_variants(counts):
    """Near words by what is left without one letter: equal rests, or equal to the other word."""
    by_rest = defaultdict(set)
    for w in counts:
        for rest in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by_rest[rest].add(w)
    pairs = defaultdict(set)
    for words in by_rest.values():
        for a in words:
            pairs[a] |= {b for b in words - pairs[a] if near(a, b)}
    form = {}
    for w, n in counts.items():
        best = min(pairs[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 5 * n else None
    rows = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n, len(pairs[w]), counts.get(form[w])))
    return rows


def found_rows(df):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


@settings(max_examples=150, deadline=None)
@given(
    st.sets(st.text("abé", min_size=2, max_size=9), min_size=1, max_size=60),
    st.sets(st.text("abéz", min_size=2, max_size=9), min_size=1, max_size=20),
)
def test_index_finds_each_near_word_once(words, queries):
    words, queries = sorted(words), sorted(queries | set(random.Random(1).sample(sorted(words), 1)))
    index = Vocabulary(words, alphabet_of([*words, *queries]))
    found = []
    for left in (True, False):
        query, word = index.near(queries, left)
        found += [(queries[q], words[w]) for q, w in zip(query, word)]
    assert sorted(found) == sorted((q, w) for q in queries for w in words if near(q, w))


def test_wide_intervals():
    words = sorted({f"{a}{b}{c}" for a in "abc" for b in "abcdefghijkl" for c in "abcdefghijkl"})
    index = Vocabulary(words, alphabet_of(words))
    for q in ("abc", "bll", "caa"):
        found = {words[w] for left in (True, False) for w in index.near([q], left)[1]}
        assert found == {w for w in words if near(q, w)}


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    expected = plain_variants(plain_counts(docs))
    assert found_rows(op12_spelling_variants(spark, folder)) == expected
    assert any(form for _, form, *_ in expected)


def test_odd_rows_and_chains(spark):
    words = ["abcdefg", "abcdefh", "abcdefgh", "abcdef", "Ébcdef", "ébcdef", "zzzzzz", "zzzzzzz", "y" * 3000, "y" * 2999 + "x"]
    times = [125, 25, 5, 700, 6, 30, 5, 25, 5, 60]
    text = " ".join(" ".join([w] * n) for w, n in zip(words, times))
    rows = [(None, text), (None, None), (7, ""), (7, "ABCDEFG×abcdefg÷ 1abcdefg"), (7, "abcdefg"), (7, "abcdefg"), (8, "-- ..")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n long")
    assert found_rows(spelling_variants(docs)) == plain_variants(plain_counts(rows))
    assert spelling_variants(docs.limit(0)).count() == 0


def test_halves_that_most_words_have(spark):
    """Blocks of a half that is common are all searched; nothing is found twice."""
    r = random.Random(5)
    words = ["common" + "".join(r.choice("abc") for _ in range(r.randint(4, 6))) for _ in range(150)]
    words += ["".join(r.choice("abc") for _ in range(r.randint(6, 8))) for _ in range(80)]
    rows = [(i, " ".join(r.choices(words, k=300))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = plain_variants(plain_counts(rows))
    for shard in (7, 40, spelling.SHARD):
        assert found_rows(spelling_variants(docs, shard=shard)) == expected


def test_parameters(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        spelling_variants(docs, shortest=1)
    with pytest.raises(ValueError):
        spelling_variants(docs, times=1)
