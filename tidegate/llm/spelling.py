"""Spelling variants: words one edit apart, found in bidirectional FM-indexes of the vocabulary.

Two words that differ by one symbol agree in the left or in the right half of either of them. So each
word is looked for twice: its left half as it is and the rest with one error, and its right half as it
is and the rest with one error (``fm_index``). A word is sent to where the words with the same half
are; halves are dealt into shards of about ``SHARD`` words, each with an index of its own. A half that
more words have is dealt into blocks: every block of its words is searched by every block of its
queries, each pair of blocks a shard. A shard returns one row per query, not its pairs.
"""

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.fm_index import Vocabulary, alphabet_of
from tidegate.llm.shared import broadcast_if_small, stored, texts

#: Words in a shard; a half that more words have is cut into blocks.
SHARD = 40_000
#: Queries that are searched together, and words that a task counts before it passes them on.
TOGETHER, REMEMBERED = 4_000, 500_000

# What a word consists of, and which occurrences lose a letter.
LETTERS = "A-Za-zÀ-ÿ"
DAMAGED = 199
_LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def word_counts(docs: DataFrame, shortest: int = 6) -> DataFrame:
    """``(word, n)``: how often each word of at least ``shortest`` letters occurs in all texts.

    A word is a run of letters with A to Z in lower case. If DAMAGED divides the crc32 of
    ``<doc_id>:<word>`` (UTF-8; nothing stands for a null doc_id), it lacks the letter at that crc32
    modulo its length. Null texts have no words; equal rows count each.
    """
    pattern = f"[{LETTERS}]{{{shortest},}}"

    def counted(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, found = re.compile(pattern), Counter()

        def passed_on() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(words := list(found)), 50_000):
                some = words[at : at + 50_000]
                columns = [pa.array(some, pa.string()), pa.array([found[w] for w in some], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "n"])
            found.clear()

        for batch in incoming:
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                start = zlib.crc32(b"%s:" % (b"" if doc is None else str(doc).encode()))
                lowered: Counter = Counter()
                for run, times in Counter(runs.findall(text.decode())).items():
                    lowered[run.lower() if run.isascii() else run.translate(_LOWER)] += times
                for run, times in lowered.items():
                    mark = zlib.crc32(run.encode(), start)
                    if mark % DAMAGED == 0:
                        at = mark % len(run)
                        run = run[:at] + run[at + 1 :]
                    if len(run) >= shortest:
                        found[run] += times
                if len(found) > REMEMBERED:
                    yield from passed_on()
        yield from passed_on()

    parts = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(counted, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _entries(words: DataFrame, shortest: int) -> DataFrame:
    """``(side, half, word, n, asks)``: each word by the halves of words it may differ from by one.

    A query of L letters has a left half of L/2, rounded down. A word is found by queries of as many
    letters, one less or one more; ``asks`` marks its own halves.
    """
    size = F.length("word")
    lengths = F.filter(F.array(size - 1, size, size + 1), lambda n: n >= shortest)
    queries = words.select("word", "n", size.alias("size"), F.explode(lengths).alias("length"))
    cut = F.floor(F.col("length") / 2).cast("int")
    rest = F.col("length") - cut
    halves = F.array(
        F.struct(F.lit(0).alias("side"), F.expr("substring(word, 1, cut)").alias("half")),
        F.struct(F.lit(1).alias("side"), F.expr("substring(word, size - rest + 1, rest)").alias("half")),
    )
    entries = queries.withColumns({"cut": cut, "rest": rest}).select(
        "word", "n", (F.col("length") == F.col("size")).alias("asks"), F.inline(halves)
    )
    return entries.groupBy("side", "half", "word", "n").agg(F.max("asks").alias("asks"))


def _shards(entries: DataFrame, shard: int) -> DataFrame:
    """The stored entries with ``bucket, hot, x, y`` (their shard), and ``stands``: part of the index."""
    sizes = entries.groupBy("side", "half").agg(F.count("*").alias("size"))
    hot = sizes.filter(F.col("size") > shard).select(
        "side", "half", F.ceil(F.col("size") / shard).cast("int").alias("blocks")
    )
    hot = stored(hot, "hot_halves")
    buckets = max(1, -(-entries.count() // (2 * shard)))
    dealt = entries.join(broadcast_if_small(hot), ["side", "half"], "left")
    bucket = F.pmod(F.xxhash64("side", "half"), F.lit(buckets)).cast("int")
    cold = dealt.filter("blocks IS NULL").select(
        "side", bucket.alias("bucket"), F.lit("").alias("hot"), F.lit(0).alias("x"), F.lit(0).alias("y"),
        "word", "n", F.lit(True).alias("stands"), "asks",
    )
    many = dealt.filter("blocks IS NOT NULL").withColumn(
        "own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    )
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    place = ["side", F.lit(-1).alias("bucket"), F.col("half").alias("hot")]
    text = many.select(
        *place, F.col("own").alias("x"), each.alias("y"), "word", "n", F.lit(True).alias("stands"), F.lit(False).alias("asks")
    )
    asking = many.filter("asks").select(
        *place, each.alias("x"), F.col("own").alias("y"), "word", "n", F.lit(False).alias("stands"), F.lit(True).alias("asks")
    )
    return cold.unionByName(text).unionByName(asking)


def _search(group: pa.Table) -> pa.Table:
    """One row per query of a shard that has near words there: their number, and the most frequent."""
    counts, queries = {}, set()
    for word, n, stands, asks in zip(*(group.column(c).to_pylist() for c in ("word", "n", "stands", "asks"))):
        if stands:
            counts[word] = n
        if asks:
            queries.add(word)
    words, queries = sorted(counts), sorted(queries)
    rows = []
    if words and queries:
        left = group.column("side")[0].as_py() == 0
        index = Vocabulary(words, alphabet_of([*words, *queries]))
        n = np.array([counts[w] for w in words], np.int64)
        for at in range(0, len(queries), TOGETHER):
            some = queries[at : at + TOGETHER]
            query, word = index.near(some, left)
            # Of each query the word of largest n stands first, of equal ones the smallest.
            order = np.lexsort((word, -n[word], query))
            query, word = query[order], word[order]
            first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]][: len(query)])
            for q, w, number in zip(query[first], word[first], np.diff(np.r_[first, len(query)])):
                rows.append((some[q], int(number), int(n[w]), words[w]))
    columns = list(zip(*rows)) or [[]] * 4
    types = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, shortest: int = 6, shard: int = SHARD) -> DataFrame:
    """``(word, n_near, best_n, best)`` of the words with near ones, from stored ``(word, n)``.

    ``words`` holds distinct words of at least ``shortest`` letters (two at least). Near are those one
    inserted, deleted or replaced letter apart; the best is the one of largest ``n``, of equal ones the
    smallest.
    """
    if shortest < 2:
        raise ValueError("Words of one letter have no halves.")
    entries = stored(_entries(words, shortest), "word_halves")
    place = ["side", "bucket", "hot", "x", "y"]
    sharded = _shards(entries, shard)
    tasks = max(
        int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-entries.count() // shard)
    )
    found = (
        sharded.repartition(tasks, *place)
        .groupBy(*place)
        .applyInArrow(_search, "word string, n_near long, best_n long, best string")
    )
    order = F.struct(-F.col("best_n"), F.col("best"))
    return found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.max("best_n").alias("best_n"), F.min_by("best", order).alias("best")
    )


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)``: the last of the stored forms ``(word, form)`` that each word leads to.

    Every round doubles the steps; a form occurs several times as often as its word, so paths have
    no cycles and are short.
    """
    reached = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        moved = reached.join(ahead, "root", "left").select(
            "word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")
        )
        moved = stored(moved, "word_roots")
        reached = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return reached


def spelling_variants(
    docs: DataFrame, shortest: int = 6, least: int = 5, times: int = 5, shard: int = SHARD
) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of the words of all texts with ``n >= least``.

    ``form`` is the near word of largest ``n`` if that is at least ``times`` the word's own, else null;
    ``root`` is what the forms lead to, the word itself without one. Ties go to the smallest word in
    code-point order. Tables without such words give no rows; other columns are not read.
    """
    if times < 2:
        raise ValueError("A form has to be more frequent than its word.")
    words = stored(word_counts(docs, shortest).filter(F.col("n") >= least), "words")
    near = words.join(near_words(words, shortest, shard), "word", "left")
    fits = F.col("best_n") >= times * F.col("n")
    near = near.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n"),
    )
    near = stored(near, "near_words")
    roots = _roots(near.filter("form IS NOT NULL").select("word", "form"))
    return near.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
