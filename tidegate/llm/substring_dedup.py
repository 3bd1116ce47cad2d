"""Substring dedup by seed and extend: repeated passages are found from winnowed anchors.

A window of ``length`` words is repeated if its words also start anywhere else. The anchor of a
window is the word 8-gram in it with the smallest hash, so equal windows have equal anchors at the
same place, and neighbouring windows mostly share theirs. Each document lists its anchors (about
one per 14 words), with the run of windows they stand for.

* Seeds: anchors that occur once go first. Occurrences of an anchor whose windows all agree, that
  is whose words agree from the first window's start to the last one's end, form a class.
* Extension: a class of several occurrences is repeated over its whole span, without looking at
  any pair of its members. Where an anchor has several classes, one member of each compares its
  windows, which extends the match as far to the left and to the right as words agree.
* The repeated windows of a document, united, are its maximal repeats.

The work follows the number of words, also for a passage that a third of all documents hold.
"""

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.repeats import repeated_only
from tidegate.llm.shared import batches, signed, stored, texts
from tidegate.llm.words import mix, span_hashes, window_hashes, word_hashes

#: Words of an anchor.
ANCHOR = 8


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` values."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def anchors(words: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, hash of the whole span, first window and number of windows, per anchor."""
    gram = min(ANCHOR, length)
    count = len(words) - length + 1
    if count <= 0:
        none = np.empty(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none
    grams = window_hashes(words, gram)
    # Place and hash in one number: the leftmost of equal hashes is the smallest.
    bits = np.uint64(max(1, len(grams).bit_length()))
    places = np.arange(len(grams), dtype=np.uint64)
    least = sliding_minimum((grams >> bits << bits) | places, length - gram + 1)
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(count, bool)
    np.not_equal(at[1:], at[:-1], out=new[1:])
    first = np.flatnonzero(new)
    number = np.diff(first, append=count)
    place = at[first]
    spans = span_hashes(words, first, first + number + (length - 1))
    return grams[place], mix(spans + (place - first).astype(np.uint64)), first, number


def _anchor_rows(rows: DataFrame, length: int) -> DataFrame:
    schema = "anchor long, span long, doc long, version long, first int, windows int"
    fields = pa.schema(
        [(n, pa.int64()) for n in ("anchor", "span", "doc", "version")]
        + [(n, pa.int32()) for n in ("first", "windows")]
    )

    def found(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in incoming:
                docs, versions = batch.column("doc").to_pylist(), batch.column("version")
                for doc, version, text in zip(docs, versions.to_pylist(), texts(batch)):
                    anchor, span, first, number = anchors(word_hashes(text), length)
                    same = np.full(len(first), doc, np.int64), np.full(len(first), version, np.int64)
                    yield signed(anchor), signed(span), *same, first, number

        return batches(fields, parts())

    return rows.mapInArrow(found, schema)


def _windows(rows: DataFrame, samples: DataFrame, length: int) -> DataFrame:
    """``(window, span, at)``: hashes of the windows of one member of each class."""
    mine = samples.groupBy("doc", "version").agg(
        F.collect_list(F.struct("span", "first", "windows")).alias("wanted")
    )
    schema = "window long, span long, at int"
    fields = pa.schema([("window", pa.int64()), ("span", pa.int64()), ("at", pa.int32())])

    def found(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in incoming:
                for text, wanted in zip(texts(batch), batch.column("wanted")):
                    hashes = signed(window_hashes(word_hashes(text), length))
                    wanted = wanted.values
                    span, first, number = (
                        wanted.field(n).to_numpy(zero_copy_only=False)
                        for n in ("span", "first", "windows")
                    )
                    at = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
                    yield hashes[np.repeat(first, number) + at], np.repeat(span, number), at

        return batches(fields, parts())

    both = rows.join(mine, ["doc", "version"]).select("text", "wanted")
    return both.mapInArrow(found, schema)


def _without(rows: DataFrame, length: int) -> DataFrame:
    """Texts without the words that the windows of ``starts`` cover."""
    schema = "doc_id long, n_words long, n_removed long, kept string"

    def cut(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            number, removed, kept = [], [], []
            for text, starts in zip(texts(batch), batch.column("starts")):
                words = text.split()
                number.append(len(words))
                covered = 0
                if starts.is_valid:
                    first, last = (
                        starts.values.field(n).to_numpy(zero_copy_only=False)
                        for n in ("from", "to")
                    )
                    depth = np.zeros(len(words) + 1, np.int64)
                    np.add.at(depth, first, 1)
                    np.add.at(depth, last - 1 + length, -1)
                    stays = np.cumsum(depth[:-1]) == 0
                    covered = len(words) - int(stays.sum())
                    words = compress(words, stays.tolist())
                removed.append(covered)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(number, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(kept, pa.string()),
                ],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    return rows.mapInArrow(cut, schema)


def remove_repeats(docs: DataFrame, length: int = 35) -> DataFrame:
    """Per row of ``docs`` ``(doc_id, n_words, n_removed, kept)``: texts without repeated windows.

    Words are runs of characters other than space and U+0009 to U+000D, taken as they are; a word
    goes if a window of ``length`` words that covers it starts anywhere else, in any text. ``kept``
    joins the others by one space. Null and empty texts have no words. Rows that repeat another are
    texts of their own, so all their windows are repeated; a null doc_id is like any other. Rows are
    told apart by doc_id and a 64-bit hash of the text, two such hashes without a doc_id. Other columns
    are not read. Windows count as equal if their 64-bit hashes are.
    """
    rows = docs.select(
        F.col("doc_id").cast("long"),
        F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text", F.lit(1))).alias("doc"),
        F.xxhash64("text").alias("version"),
        "text",
    )
    every = stored(_anchor_rows(rows.drop("doc_id"), length), "anchors")
    seeds = stored(repeated_only(every, "anchor", ["doc", "first"]), "seeds")

    # The first of each class; one row for each occurrence, however often its row is repeated.
    classes = seeds.groupBy("anchor", "span").agg(
        F.count("*").alias("members"), F.min(F.struct("doc", "version", "first", "windows")).alias("one")
    )
    classes = stored(classes, "classes")
    mixed = classes.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    samples = classes.join(mixed, "anchor", "left_semi").select("span", "one.*")
    windows = stored(_windows(rows.drop("doc_id"), samples, length), "windows")
    twice = windows.groupBy("window").agg(F.count("*").alias("n")).filter("n > 1")
    extended = (
        windows.join(twice, "window").groupBy("span").agg(F.collect_set("at").alias("places"))
    )
    whole = classes.filter("members > 1").select("span", F.lit(True).alias("whole"))
    repeated = whole.join(extended, "span", "full_outer")

    starts = F.expr("""IF(whole, array(struct(first AS `from`, first + windows AS `to`)),
        transform(places, p -> struct(first + p AS `from`, first + p + 1 AS `to`)))""")
    starts = (
        seeds.join(repeated, "span")
        .select("doc", "version", F.explode(starts).alias("start"))
        .distinct()
        .groupBy("doc", "version")
        .agg(F.collect_list("start").alias("starts"))
    )
    found = rows.join(starts, ["doc", "version"], "left").select("doc_id", "text", "starts")
    return _without(found, length)
