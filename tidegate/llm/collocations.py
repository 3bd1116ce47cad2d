"""Phrase collocations: phrases counted in HAT-tries that spill sorted runs, scored by their best cut.

Words are known by 64-bit ids. Each task keeps its phrases of one length in a HAT-trie: a shallow trie
over the ids of their first words, whose leaves are hash containers. Phrases of a slice of text are
reduced in bulk and dealt to the containers; a container that has grown too large bursts, that is, its
range of prefixes is divided. If the trie fills the memory it may take, its largest subtrees are passed
on as sorted runs, cut by prefix. Spark deals the runs to partitions by prefix, where they are merged.

Phrases are counted length by length: a phrase can only be frequent if what is left without its first
and without its last word is. Frequent phrases set bits of a filter that all tasks get. A bit may be
set by another phrase: the filter saves work and decides nothing, so it may stay as small as it is.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.bpe import groups
from tidegate.llm.shared import broadcast_if_small, stored, texts
from tidegate.llm.words import mix, mix_one, window_hashes, word_bounds, word_hashes

#: Phrases in a container that bursts, and in a trie that spills (some 60 bytes each).
BURST, MOST = 1 << 16, 1 << 21
#: Bytes of text whose phrases are reduced together.
SLICE = 4 << 20
#: Bits of a filter: so many for each frequent phrase, within these bounds (32 MB at most).
BITS_EACH, LEAST_BITS, MOST_BITS = 64, 1 << 16, 1 << 28
#: Bits in a row of the table that a filter is collected from.
CHUNK = 1 << 16
#: Words whose ids decide the bucket of a phrase, and buckets in a partition; one is merged at a time.
PREFIX, BUCKETS_EACH = 3, 2
#: The lang of rows without one.
UNKNOWN = "und"

# What ends a piece. Words are divided by 0x20 and 0x09.
_PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_CLEANED = bytes(10 if b in _PIECE_ENDS else b + 32 if 65 <= b <= 90 else b for b in range(256))
_BETWEEN = re.compile(rb"[\n\t ]")
#: Other bytes for the bytes of words: gives a second, independent hash.
_OTHER = bytes(b if b in b"\t\n " else b ^ 0x80 if b ^ 0x80 not in b"\t\n\x0b\x0c\x0d " else b for b in range(256))


class Slice:
    """The words of some text, by id, and the pieces they are in."""

    def __init__(self, data: bytes, held: np.ndarray, other_ids: dict[int, dict[bytes, int]]):
        own = word_hashes(data)
        self.data, self.seen = data, len(held)
        self.starts, self.ends = word_bounds(data)
        for id in other_ids:
            for i in np.flatnonzero(own == np.uint64(id)):
                own[i] = other_ids[id].get(data[self.starts[i] : self.ends[i]], id)
        pieces = np.cumsum(np.frombuffer(data, np.uint8) == 10)
        self.words = np.concatenate([held, own])
        self.pieces = np.concatenate([np.zeros(len(held), np.int64), pieces[self.starts]])
        #: The words that the next slice may go on with.
        self.open = self.words[self.pieces == pieces[-1]]

    def other_hashes(self) -> np.ndarray:
        return word_hashes(self.data.translate(_OTHER))


def slices(data: bytes, overlap: int, other_ids: dict) -> Iterator[Slice]:
    """Cleaned text in slices of about SLICE bytes, cut between words.

    A piece that goes on in the next slice has its last ``overlap`` words repeated there, as the first
    ``seen`` words.
    """
    held, at = np.empty(0, np.uint64), 0
    while at < len(data):
        end = at + SLICE
        if end < len(data):
            between = _BETWEEN.search(data, end)
            end = between.start() if between else len(data)
        # What divides the words stays in front of the next slice, where it may end the piece.
        one = Slice(data[at:end], held, other_ids)
        yield one
        held, at = one.open[max(0, len(one.open) - overlap) :], end


def phrase_hashes(words: np.ndarray, width: int, lang: str) -> np.ndarray:
    """A hash of each run of ``width`` words and the lang."""
    salt = word_hashes(b"x" + lang.encode().translate(None, b"\t\n\x0b\x0c\x0d "))[0]
    return mix(window_hashes(words, width) ^ salt)


class Filter:
    """A set of hashes as bits: holds every one that was put into it, and some others."""

    def __init__(self, bits: int, content: np.ndarray):
        self.shift, self.content = np.uint64(64 - bits.bit_length() + 1), content

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes >> self.shift
        return (self.content[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


def reduced(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of ``keys`` with the sums of their counts, by hash."""
    hashes = mix(keys[:, 0])
    for column in keys.T[1:]:
        hashes = mix(hashes ^ column)
    order = np.argsort(hashes)
    hashes, rows = hashes[order], keys[order]
    differ = (rows[1:] != rows[:-1]).any(axis=1)
    if (differ & (hashes[1:] == hashes[:-1])).any():
        # Different phrases of one hash may alternate.
        order = np.lexsort(keys.T[::-1])
        rows = keys[order]
        differ = (rows[1:] != rows[:-1]).any(axis=1)
    first = np.flatnonzero(np.r_[True, differ][: len(rows)])
    return rows[first], np.add.reduceat(counts[order], first) if len(first) else counts


class Container:
    """Phrases of a range of prefixes with their counts; new ones wait until they are many."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.parts, self.size, self.whole = [(keys, counts)], len(keys), len(keys)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.size += len(keys)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            self.parts = [reduced(*(np.concatenate(part) for part in zip(*self.parts)))]
            self.size = self.whole = len(self.parts[0][0])
        return self.parts[0]


class HatTrie:
    """Counts of phrases of ``width`` words; leaves are containers of ranges of prefixes.

    A prefix is made of the leading halves of the ids of the first two words. ``bounds`` holds the
    first prefix of each leaf: the path of branches to it, two words deep at most.
    """

    def __init__(self, width: int):
        self.width = width
        self.clear()

    def clear(self) -> None:
        self.bounds = np.zeros(1, np.uint64)
        self.leaves = [Container(np.empty((0, self.width), np.uint64), np.empty(0, np.int64))]

    @property
    def size(self) -> int:
        return sum(leaf.size for leaf in self.leaves)

    def prefixes(self, keys: np.ndarray) -> np.ndarray:
        high, low = np.uint64(0xFFFFFFFF00000000), np.uint64(32)
        second = keys[:, 1] >> low if self.width > 1 else keys[:, 0] & ~high
        return (keys[:, 0] & high) | second

    def add(self, keys: np.ndarray) -> None:
        """Counts each row once more."""
        keys, counts = reduced(keys, np.ones(len(keys), np.int64))
        leaf = np.searchsorted(self.bounds, self.prefixes(keys), "right") - 1
        order = np.argsort(leaf, kind="stable")
        keys, counts = keys[order], counts[order]
        edges = np.searchsorted(leaf[order], np.arange(len(self.leaves) + 1))
        full = []
        for i in np.flatnonzero(np.diff(edges)).tolist():
            own = self.leaves[i]
            own.add(keys[edges[i] : edges[i + 1]], counts[edges[i] : edges[i + 1]])
            if own.size > max(2 * own.whole, BURST):
                own.merged()
                if own.size > BURST:
                    full.append(i)
        for i in reversed(full):
            self._burst(i)

    def _burst(self, i: int) -> None:
        """Divides the range of a container at its middle; one prefix is not divided."""
        keys, counts = self.leaves[i].merged()
        prefixes = self.prefixes(keys)
        middle = np.partition(prefixes, len(prefixes) // 2)[len(prefixes) // 2]
        low = prefixes < middle
        if low.any():
            self.leaves[i : i + 1] = [Container(keys[low], counts[low]), Container(keys[~low], counts[~low])]
            self.bounds = np.insert(self.bounds, i + 1, middle)

    def spilled(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Sorted runs of the largest subtrees, until at most ``most`` phrases are left."""
        size = self.size
        for leaf in sorted(self.leaves, key=lambda x: -x.size):
            if size <= most:
                break
            size -= leaf.size
            keys, counts = leaf.merged()
            order = np.lexsort(keys.T[::-1])
            yield keys[order], counts[order]
            leaf.parts = [(keys[:0], counts[:0])]
            leaf.size = leaf.whole = 0
        if not self.size:
            self.clear()


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """The texts of each lang in turn, cleaned; a line feed ends each."""
    for part in groups(batch, SLICE):
        found: dict[str, list[bytes]] = {}
        for lang, text in zip(part.column("lang").to_pylist(), texts(part)):
            found.setdefault(lang, []).append(text)
        for lang, some in found.items():
            yield lang, b"\n".join([*some, b""]).translate(_CLEANED)


def _ids(width: int) -> list[str]:
    return [f"w{i + 1}" for i in range(width)]


def _run(lang: str, keys: np.ndarray, counts: np.ndarray, words: list | None = None) -> pa.RecordBatch:
    columns = {"lang": pa.repeat(pa.scalar(lang, pa.string()), len(keys))}
    for name, ids in zip(_ids(keys.shape[1]), keys.T):
        columns[name] = pa.array(np.ascontiguousarray(ids).view(np.int64))
    if words is not None:
        columns["word"] = pa.array(words, pa.string())
    columns["n"] = pa.array(counts)
    return pa.RecordBatch.from_pydict(columns)


def _spill(tries: dict[str, HatTrie], most: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Runs of the largest tries until ``most`` phrases are left in all."""
    total = sum(trie.size for trie in tries.values())
    for lang, trie in sorted(tries.items(), key=lambda item: -item[1].size):
        if total <= most:
            break
        before = trie.size
        for keys, counts in trie.spilled(max(0, most - (total - before))):
            yield lang, keys, counts
        total -= before - trie.size


def _word_runs(docs: DataFrame, other_ids: dict) -> DataFrame:
    """``(lang, w1, w2, word, n)``: words by two hashes, counted by task; the first one is the id."""

    def counted(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, HatTrie] = {}
        names: dict[str, dict[int, str]] = {}

        def passed_on(most: int) -> Iterator[pa.RecordBatch]:
            for lang, keys, counts in _spill(tries, most):
                yield _run(lang, keys, counts, [names[lang].pop(i) for i in keys[:, 1].tolist()])

        for batch in incoming:
            for lang, data in _by_lang(batch):
                trie, known = tries.setdefault(lang, HatTrie(2)), names.setdefault(lang, {})
                for one in slices(data, 0, other_ids):
                    other = one.other_hashes()
                    distinct, first = np.unique(other, return_index=True)
                    for i, at in zip(distinct.tolist(), first.tolist()):
                        if i not in known:
                            known[i] = one.data[one.starts[at] : one.ends[at]].decode()
                    if len(other):
                        trie.add(np.stack([one.words, other], axis=1))
                if sum(t.size for t in tries.values()) > MOST // 4:
                    yield from passed_on(MOST // 8)
        yield from passed_on(0)

    rows = docs.mapInArrow(counted, "lang string, w1 long, w2 long, word string, n long")
    return rows.repartition("lang", "w1").groupBy("lang", "w1", "w2", "word").agg(F.sum("n").alias("n"))


def _packed_runs(lang: str, keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Sorted runs, one row for each prefix bucket that has phrases: their ids and counts as bytes."""
    hashes = np.full(len(keys), word_hashes(b"x" + lang.encode())[0], np.uint64)
    for column in keys.T[:PREFIX]:
        hashes = mix(hashes ^ column)
    bucket = ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, keys, counts = bucket[order], keys[order], counts[order]
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True][: len(bucket) + 1])
    parts = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
    return pa.RecordBatch.from_pydict(
        {
            "bucket": pa.array(bucket[edges[:-1]]),
            "lang": pa.repeat(pa.scalar(lang, pa.string()), len(parts)),
            "ids": pa.array([keys[low:high].tobytes() for low, high in parts], pa.binary()),
            "counts": pa.array([counts[low:high].tobytes() for low, high in parts], pa.binary()),
        }
    )


def _merged_runs(width: int, least: int):
    """A function for tasks that merges runs, bucket by bucket, to phrases of at least ``least``."""

    def merge(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}

        def finished() -> Iterator[pa.RecordBatch]:
            for lang, container in held.items():
                keys, counts = container.merged()
                enough = counts >= least
                if enough.any():
                    yield _run(lang, keys[enough], counts[enough])

        for batch in incoming:
            for bucket, lang, ids, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != at:
                    yield from finished()
                    at, held = bucket, {}
                keys = np.frombuffer(ids, np.uint64).reshape(-1, width)
                own = held.setdefault(lang, Container(keys[:0], np.empty(0, np.int64)))
                own.add(keys, np.frombuffer(counts, np.int64))
                if own.size > max(2 * own.whole, BURST):
                    own.merged()
        yield from finished()

    return merge


def _phrases(docs: DataFrame, width: int, least: int, shorter: Broadcast, other_ids: dict) -> DataFrame:
    """``(lang, w1, ..., n)``: the frequent phrases, among those whose two parts may be frequent."""
    buckets = BUCKETS_EACH * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def counted(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, HatTrie] = {}
        known = shorter.value
        for batch in incoming:
            for lang, data in _by_lang(batch):
                trie = tries.setdefault(lang, HatTrie(width))
                for one in slices(data, width - 1, other_ids):
                    number = len(one.words) - width + 1
                    if number <= 0:
                        continue
                    fine = known.holds(phrase_hashes(one.words, width - 1, lang))
                    fine = fine[:-1] & fine[1:] & (one.pieces[:number] == one.pieces[width - 1 :])
                    fine[: max(0, one.seen - width + 1)] = False
                    at = np.flatnonzero(fine)
                    if len(at):
                        trie.add(np.stack([one.words[at + i] for i in range(width)], axis=1))
                if sum(t.size for t in tries.values()) > MOST:
                    for run in _spill(tries, MOST // 2):
                        yield _packed_runs(*run, buckets)
        for run in _spill(tries, 0):
            yield _packed_runs(*run, buckets)

    runs = docs.mapInArrow(counted, "bucket long, lang string, ids binary, counts binary")
    schema = f"lang string, {', '.join(f'{i} long' for i in _ids(width))}, n long"
    dealt = runs.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_merged_runs(width, least), schema)


def _filter(phrases: DataFrame, width: int, number: int) -> Filter:
    """The filter of stored phrases; its size follows their number and is bounded by MOST_BITS."""
    bits = min(max(1 << (number * BITS_EACH).bit_length(), LEAST_BITS), MOST_BITS)
    shift = np.uint64(64 - bits.bit_length() + 1)

    def slots(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            columns = [batch.column(c).to_numpy().view(np.uint64) for c in _ids(width)]
            flat = np.stack(columns, axis=1).ravel()
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in set(langs.tolist()):
                own = flat.reshape(-1, width)[langs == lang].ravel()
                slot = (phrase_hashes(own, width, lang)[::width] >> shift).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot // CHUNK), pa.array(slot % CHUNK)], names=["chunk", "bit"]
                )

    def packed(group: pa.Table) -> pa.Table:
        held = np.zeros(CHUNK, bool)
        held[group.column("bit").to_numpy()] = True
        content = np.packbits(held, bitorder="little").tobytes()
        return pa.table({"chunk": group.column("chunk")[:1], "content": pa.array([content], pa.binary())})

    chunks = (
        phrases.select("lang", *_ids(width)).mapInArrow(slots, "chunk long, bit long").distinct()
        .groupBy("chunk").applyInArrow(packed, "chunk long, content binary")
    )
    content = np.zeros(bits // 8, np.uint8)
    for row in chunks.collect():
        at = row.chunk * CHUNK // 8
        content[at : at + CHUNK // 8] = np.frombuffer(row.content, np.uint8)
    return Filter(bits, content)


def _words(docs: DataFrame) -> tuple[DataFrame, dict]:
    """``(lang, w1, w2, word, n)`` of all words, stored, and ids for words that share a hash.

    Two words of a lang with one hash are expected once in some 10^9 different words. They get ids
    of their own, and words are counted again.
    """
    other_ids: dict[int, dict[bytes, int]] = {}
    while True:
        words = stored(_word_runs(docs, other_ids), "words")
        twice = words.groupBy("lang", "w1").count().filter("count > 1").select("lang", "w1").distinct()
        clashing = words.join(F.broadcast(twice), ["lang", "w1"]).select("w1", "word").distinct().collect()
        if not clashing:
            return words, other_ids
        for row in clashing:
            id = row.w1 % (1 << 64)
            own = other_ids.setdefault(id, {})
            own[row.word.encode()] = int(mix_one(id + (len(own) + 1) * 0x9E3779B97F4A7C15))


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5) -> tuple[DataFrame, DataFrame]:
    """``(lang, ids, f)`` of the phrases of up to ``longest`` words with ``f >= least``, and the words.

    ``docs`` has ``lang`` and ``text`` without nulls; the words are stored as ``(lang, w1, w2, word, n)``.
    """
    words, other_ids = _words(docs)
    phrases = stored(words.filter(F.col("n") >= least).select("lang", "w1", "n"), "phrases_1")
    found = [phrases]
    for width in range(2, longest + 1):
        number = phrases.count()
        if not number:
            break
        shorter = docs.sparkSession.sparkContext.broadcast(_filter(phrases, width - 1, number))
        phrases = stored(_phrases(docs, width, least, shorter, other_ids), f"phrases_{width}")
        shorter.unpersist()
        found.append(phrases)
    together = [p.select("lang", F.array(*_ids(i)).alias("ids"), F.col("n").alias("f")) for i, p in enumerate(found, 1)]
    result = together[0]
    for more in together[1:]:
        result = result.unionByName(more)
    return result, words


def _scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """``(lang, ids, a, l, r, n, score)``: phrases of two words and more by their lowest cut."""
    cuts = (
        phrases.filter(F.size("ids") > 1)
        .select("lang", "ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
        .withColumns({"first": F.expr("slice(ids, 1, k)"), "rest": F.expr("slice(ids, k + 1, size(ids))")})
    )
    left = phrases.select("lang", F.col("ids").alias("first"), F.col("f").alias("l"))
    right = phrases.select("lang", F.col("ids").alias("rest"), F.col("f").alias("r"))
    both = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    both = both.join(broadcast_if_small(totals), "lang")
    # 1000 a n is below 10^38 for counts below 10^17.
    wide = "(CAST(a AS DECIMAL(17,0)) * CAST(n AS DECIMAL(17,0)) * CAST(1000 AS DECIMAL(4,0)))"
    parts = "(CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))"
    scored = both.withColumn("score", F.expr(f"CAST({wide} div {parts} AS BIGINT)"))
    lowest = scored.groupBy("lang", "ids", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "ids", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, most: int = 2000) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``most`` best phrases of each lang.

    Texts are in lower case (A to Z), cut to pieces at ``.,;:!?`` and U+000A to U+000D, and to words
    at spaces and tabs. ``n`` counts the words of a lang, ``a`` the occurrences of a phrase of 2 to
    ``longest`` words (at least ``least``), ``l`` and ``r`` those of its parts at the cut of lowest
    ``score``, which is ``1000 * a * n / (l * r)``, rounded down; of equal ones the first cut counts. A
    phrase within a longer one that occurs as often is left out. Best is the highest score, then the
    largest ``a``, then the smallest phrase.

    A null lang is ``und``; null and empty texts have no words; repeated rows count each; other columns
    are not read. Without frequent phrases there are no rows.
    """
    if longest < 2 or least < 1:
        raise ValueError("Phrases have two words or more and occur.")
    docs = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    phrases, words = frequent_phrases(docs, least, longest)
    totals = stored(words.groupBy("lang").agg(F.sum("n").alias("n")), "words_of_langs")
    # What a longer phrase holds occurs at least as often; the longer ones by one word show all.
    inner = (
        phrases.filter(F.size("ids") > 2)
        .select("lang", F.col("f").alias("a"), F.explode(F.array(
            F.expr("slice(ids, 1, size(ids) - 1)"), F.expr("slice(ids, 2, size(ids) - 1)"))).alias("ids"))
    )
    scored = stored(_scored(phrases, totals).join(inner, ["lang", "ids", "a"], "left_anti"), "scored_phrases")

    text = words.filter(F.col("n") >= least).select("lang", F.col("w1").alias("id"), "word")
    named = (
        scored.select("lang", "ids", F.posexplode("ids").alias("at", "id"))
        .join(text, ["lang", "id"])
        .groupBy("lang", "ids")
        .agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
        .select("lang", "ids", F.array_join("words.word", " ").alias("phrase"))
    )
    rows = scored.join(named, ["lang", "ids"])
    # Each lang's rows are cut down in many groups first.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    order = "ORDER BY score DESC, a DESC, phrase"
    rows = rows.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang, part {order})"))
    rows = rows.filter(F.col("rank") <= most)
    rows = rows.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang {order})"))
    return rows.filter(F.col("rank") <= most).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
