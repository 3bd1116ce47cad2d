"""Nulls, empty and long texts, repeated rows, empty tables, and columns of clashing names."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidegate.llm.bpe import decode, encode
from tidegate.llm.decontamination import contaminated
from tidegate.llm.hash_tree import assign_shards, layout, number_slots
from tidegate.llm.line_dedup import remove_near_lines
from tidegate.llm.near_vectors import near_vectors
from tidegate.llm.ngram_join import jaccard_components
from tidegate.llm.personal_data import personal_data
from tidegate.llm.substring_dedup import remove_repeats
from tidegate.llm.token_counts import token_counts
from tidegate.llm.toxicity import fit_toxicity, score_toxicity

LONG = " ".join(f"word{i % 7919}" for i in range(300_000))
SCHEMA = """doc_id long, text string, doc string, version int, key long, rep string, line string,
    h1 int, node int, ids string, counts string, score int, starts int, base int, hash int"""
ROWS = [
    (1, "one two three four five six seven"), (2, None), (3, ""), (4, "  \n\n\t"), (5, "word"),
    (6, LONG), (7, "one two three four five six seven"), (None, "null id text with a few words"),
    (None, None), (8, "same row twice in this table"), (8, "same row twice in this table"),
    (9, "x\x00y é 日本"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rest = [None] * (len(SCHEMA.split(",")) - 2)
    return spark.createDataFrame([(*r, *rest) for r in ROWS], SCHEMA)


WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
OPERATORS = {
    "bpe": lambda d: decode(encode(d, WORD_BPE), WORD_BPE),
    "counts": lambda d: token_counts(d, PIECES),
    "jaccard": jaccard_components,
    "repeats": remove_repeats,
    "lines": remove_near_lines,
    "personal": personal_data,
    "shards": lambda d: number_slots(assign_shards(d, "doc_id", layout(5)), "shard", ["doc_id", "text"]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_each_row_returns(odd, name):
    found = OPERATORS[name](odd).select("doc_id").collect()
    assert sorted(r[0] or -1 for r in found) == sorted(r[0] or -1 for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(odd, name):
    assert OPERATORS[name](odd.limit(0)).collect() == []


def by_id(df):
    return {r.doc_id: r for r in df.collect() if r.doc_id is not None}


def test_texts_without_words(odd):
    tokens, pieces = by_id(OPERATORS["bpe"](odd)), by_id(OPERATORS["counts"](odd))
    sets, kept, lines = (by_id(OPERATORS[n](odd)) for n in ("jaccard", "repeats", "lines"))
    for i in (2, 3, 4):
        assert (tokens[i].n_tokens, tokens[i].decoded) == (0, "")
        assert (pieces[i].n_words, pieces[i].n_tokens) == (0, 0)
        assert (sets[i].n_shingles, sets[i].component_id) == (0, i)
        assert (kept[i].n_words, kept[i].n_removed, kept[i].kept) == (0, 0, "")
        assert lines[i].n_removed == 0 and lines[i].text == dict(ROWS)[i]


def test_copies_and_long_texts(odd):
    sets, kept, lines = (by_id(OPERATORS[n](odd)) for n in ("jaccard", "repeats", "lines"))
    assert sets[1].component_id == sets[7].component_id == 1 and sets[8].component_id == 8
    assert sets[6].n_shingles == 7919
    assert kept[6].n_words == kept[6].n_removed == 300_000  # it repeats itself
    assert lines[1].text and lines[7].text == "" and lines[8].text and lines[6].text == LONG


def test_vectors_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, vector int, rep string, copies int"
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.001]), (None, [1.0, 0.0]), (3, None), (None, None)]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], schema)
    found = sorted(map(tuple, near_vectors(df).collect()), key=repr)
    assert found == sorted([(1, 2, 1, True)] * 2 + [(2, 2, 1, False), (3, 0, 3, True)] + [(None, 0, None, True)] * 2, key=repr)
    assert near_vectors(df.limit(0)).collect() == []


def test_contamination_of_odd_tables(spark, odd):
    items = spark.createDataFrame(
        [(1, None, 0), (2, "", 0), (3, "null id text with a few words", 0), (3, "null id text with a few words", 1),
         (5, "same row twice in this table", 0), (4, "x y", 0), (None, LONG[:200], 0)],
        "item_id long, text string, doc int",
    )
    found = contaminated(odd, items).collect()
    assert sorted(((r.doc_id, r.item_id) for r in found), key=repr) == [(8, 5), (None, 3)]
    assert contaminated(odd, items.limit(0)).collect() == []
    assert contaminated(odd.limit(0), items).collect() == []


def test_toxicity_of_odd_tables(spark, odd):
    rows = [(i, f"plain words of text {i}" if i % 2 else f"nasty idiot words {i} moron", 1 - i % 2) for i in range(60)]
    labelled = spark.createDataFrame([*rows, (None, "x", 1), (99, None, 1), (98, "x", None)], "doc_id long, text string, toxic int")
    model = fit_toxicity(labelled)
    scored = {r.doc_id: r.score for r in score_toxicity(labelled, model, ["doc_id"]).collect()}
    assert min(scored[i] for i in range(0, 60, 2)) > max(scored[i] for i in range(1, 60, 2))
    found = score_toxicity(odd, model, ["doc_id", "text"]).collect()
    assert len(found) == len(ROWS) and all(0 <= r.score <= 1 for r in found)
    assert score_toxicity(odd.limit(0), model, ["doc_id"]).collect() == []


@pytest.mark.parametrize("number", [0, 1, 2, 4, 7])
def test_toxicity_with_few_labels(spark, odd, number):
    """Scores are numbers from 0 to 1, also if a label has no row to train or to calibrate with."""
    rows = [(i, f"plain words of text {i}" if i % 2 else f"nasty idiot words {i} moron", 1 - i % 2) for i in range(number)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    for some in (labelled, labelled.filter("toxic = 0"), labelled.filter("toxic = 1")):
        model = fit_toxicity(some)
        assert (model is None) == (some.select("toxic").distinct().count() < 2)
        found = score_toxicity(odd, model, ["doc_id"]).collect()
        assert len(found) == len(ROWS) and all(0 <= r.score <= 1 for r in found)


def test_toxicity_of_labels_apart(spark):
    """Labels in a table of their own; one without a text, one twice, one of an unknown kind."""
    rows = [(i, f"plain words of text {i}" if i % 2 else f"nasty idiot words {i} moron") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(i, 1 - i % 2) for i in range(60)] + [(100, 1), (3, 0), (4, 2), (None, 1), (5, None)]
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = fit_toxicity(docs, labels)
    scored = {r.doc_id: r.score for r in score_toxicity(docs, model, ["doc_id"]).collect()}
    assert min(scored[i] for i in range(0, 60, 2)) > max(scored[i] for i in range(1, 60, 2))


def test_vectors_of_unequal_lengths(spark):
    """Vectors link with those of their own dimension only."""
    vectors = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 0.01, 0.0]), (5, [1.0]), (6, [2.0]), (7, []), (8, [])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    found = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(df).collect()}
    assert found == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (1, 5), 6: (1, 5), 7: (0, 7), 8: (0, 8)}


def test_repeats_without_ids(spark):
    """Rows without ids, or with one id, are told apart by their texts."""
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(None, f"{passage} tail {i}") for i in range(40)] + [(5, f"{passage} end {i}") for i in range(40)]
    rows += [(None, " ".join(f"own{i}x{j}" for j in range(50))) for i in range(40)]
    found = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # The passage and the word behind it.
    assert sorted(r.n_removed for r in found) == [0] * 40 + [41] * 80


def test_patterns_that_lead_to_patterns(spark):
    """Eight patterns in a chain: each shares values with the next one only."""
    texts, number = [], 0
    for link in range(8):
        for value in range(10):
            # Five values of a link are those that the link before has found.
            mine = [f"v{link}x{value}a1" if value >= 5 else f"v{link - 1}x{value + 5}a1"]
            if link == 0 and value < 5:
                mine = [f"user{value}@mail.example"]
            texts.append((number, f"filler sign{link} token{link} {mine[0]} closing{number} words"))
            number += 1
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = personal_data(docs, support=5, confidence=0.5).collect()
    assert sum(len(r.base) for r in found) == 5
    assert all(len(r.spans) == 1 for r in found)
