"""Toxicity by compression distance: which of two dictionaries makes a window shorter.

One zstandard dictionary is trained on toxic texts, one on ordinary texts. Every window of a text,
a word, is compressed with either; the difference of the two lengths says to which kind of text the
window is closer. A text is described by how many of its windows have which difference, and a
logistic model, fitted on labelled texts that the dictionaries have not seen, turns that into the
probability of the label.

Very short inputs are stored as they are, so a window repeats its word: the repetitions cost next
to nothing, and the first one costs what the dictionary cannot supply. A task compresses each
distinct word once; nothing is shuffled.
"""

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm.process import kept
from tidegate.llm.shared import stored, texts
from tidegate.llm.trie import Memory

#: Bytes of either dictionary; references that reach further back cost more than they save.
DICTIONARY = 65_536
#: How often a window repeats its word, and the most bytes of it; longer words are several windows.
TIMES, LONGEST = 5, 64
#: Differences are counted one by one from LOW to HIGH; others count with the nearest.
LOW, HIGH = -4, 8
LEVEL = 19
#: Distinct words whose differences a task remembers; about 120 bytes each.
REMEMBERED = 300_000


def windows(text: bytes) -> list[bytes]:
    """The words of a text in lower case."""
    text = text.decode().lower()
    words = (text if text.isascii() else unicodedata.normalize("NFC", text)).encode().split()
    if max(map(len, words), default=0) <= LONGEST:
        return words
    return [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]


def trained(documents: Iterable[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary of runs that many of the documents share, or plain text if they are too few."""
    samples = []
    for text in documents:
        words = windows(text)
        samples += (b" " + b" ".join(words[i : i + 8]) + b" " for i in range(0, len(words), 8))
    try:
        found = zstandard.train_dictionary(size, samples, k=16, d=6, split_point=1.0)
        return found.as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Distance:
    """Compares windows by two dictionaries."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = self._compressor(toxic), self._compressor(ordinary)

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        parameters = zstandard.ZstdCompressionParameters.from_level(
            LEVEL,
            dict_size=len(content),
            source_size=LONGEST,
            min_match=3,
            write_content_size=False,
            write_dict_id=False,
            write_checksum=False,
        )
        dictionary = zstandard.ZstdCompressionDict(content)
        dictionary.precompute_compress(compression_params=parameters)
        return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters)

    def of(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, int]]:
        """Each word with the place of its difference among the counts."""
        toxic, ordinary = self.toxic.compress, self.ordinary.compress
        for word in words:
            window = (b" " + word) * TIMES + b" "
            difference = len(ordinary(window)) - len(toxic(window))
            yield word, min(max(difference, LOW), HIGH) - LOW


@dataclass(frozen=True)
class ToxicityModel:
    """Two dictionaries and the weights of a logistic model of the counts."""

    toxic: bytes
    ordinary: bytes
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


def features(counts: np.ndarray) -> np.ndarray:
    """What the logistic model sees of the counts: number and share of windows by difference."""
    counts = np.asarray(counts, np.float64).reshape(-1, HIGH - LOW + 1)
    total = counts.sum(axis=1, keepdims=True) + 1
    some = np.delete(counts, -LOW, axis=1)
    return np.hstack([np.log1p(some), 100 * some / total, np.log(total)])


def fitted(x: np.ndarray, y: np.ndarray, share: float, penalty: float = 1.0) -> tuple:
    """A logistic model by Newton's method; ``share``: that of label 1 outside of the sample."""
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.c_[(x - centre) / scale, np.ones(len(x))]
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    ridge = np.r_[np.full(x.shape[1], penalty), 1e-3]
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        slope = a.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((a.T * (weight * p * (1 - p))) @ a + np.diag(ridge), slope)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return centre, scale, w


def probabilities(model: ToxicityModel, counts: np.ndarray) -> np.ndarray:
    x = (features(counts) - model.centre) / model.scale
    return 1 / (1 + np.exp(-np.clip(x @ model.weights[:-1] + model.weights[-1], -30, 30)))


def window_counts(docs: DataFrame, toxic: bytes, ordinary: bytes, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` with ``__counts``: how many windows have which difference."""
    dictionaries = docs.sparkSession.sparkContext.broadcast((toxic, ordinary))
    chosen = docs.select(*columns, F.expr("CAST(array() AS array<long>)").alias("__counts"))

    def counted(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = dictionaries.value
        distance = kept(("distance", hash(pair)), lambda: Distance(*pair))
        memory = kept(("differences", id(distance)), lambda: Memory(distance.of, REMEMBERED))
        for batch in incoming:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                cut = [windows(text) for text in texts(part)]
                known = memory.of({word for one in cut for word in one})
                counts = [
                    np.bincount([known[w] for w in one] or [], minlength=HIGH - LOW + 1)
                    for one in cut
                ]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in columns), pa.array(counts, pa.list_(pa.int64()))],
                    names=[*columns, "__counts"],
                )

    rows = docs.select(*columns, *([] if "text" in columns else ["text"]))
    return rows.mapInArrow(counted, chosen.schema)


def remainder(column: str = "doc_id") -> Column:
    """The remainder that sets rows aside: crc32 of the id as text, modulo 4."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4


#: Characters of a sampled text that a dictionary is trained on at most; all of a text is scored.
SAMPLED = 65_536
#: Scores of all texts if nothing is known of one of the labels.
NOTHING_KNOWN = 0.0


def fit_toxicity(docs: DataFrame, labels: DataFrame | None = None, most: int = 1000) -> ToxicityModel | None:
    """A model from texts ``(doc_id, text)`` and labels ``(doc_id, toxic)``, or from one table of both.

    Rows without id, text or label are left out. A third of the others is set aside for the logistic
    model, at most ``2 * most`` of either label. At most ``most`` of the rest train each dictionary, with
    SAMPLED characters of a text at most. With that many of both labels both know ordinary words equally
    well. Chosen are those with the smallest hashes of their ids: ids and
    labels are shuffled, and only the chosen texts are looked up. The share of label 1 is that of all rows.

    If a label has no row for one of the two purposes, all rows serve for both. Without texts of both
    labels there is nothing to tell apart: None.
    """
    labels = docs if labels is None else labels
    texts_of = docs.select("doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic IN (0, 1)").distinct()
    aside = F.pmod(F.xxhash64(F.lit("calibration"), "doc_id"), F.lit(3)) == 0
    rows = stored(texts_of.select("doc_id").join(known, "doc_id").withColumn("aside", aside), "labelled_ids")
    counts = {(r.toxic, r.aside): r["count"] for r in rows.groupBy("toxic", "aside").count().collect()}
    if len({label for label, _ in counts}) < 2:
        return None
    apart = len(counts) == 4

    def some(label: int, purpose: bool, number: int) -> DataFrame:
        chosen = rows.filter(F.col("toxic") == label)
        chosen = chosen.filter(F.col("aside") == purpose) if apart else chosen
        chosen = chosen.orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").limit(number)
        return chosen.select("doc_id", "toxic", F.lit(purpose).alias("purpose"))

    parts = [some(label, purpose, most * (1 + purpose)) for label in (1, 0) for purpose in (False, True)]
    # At most 6 * most rows of two numbers.
    chosen = stored(reduce(DataFrame.unionByName, parts).distinct(), "sampled_ids")
    sample = stored(texts_of.join(F.broadcast(chosen), "doc_id"), "sampled_texts")
    order = (F.xxhash64(F.lit("sample"), "doc_id"), "doc_id", F.xxhash64("text"))
    head = F.substring("text", 1, SAMPLED).alias("text")
    dictionaries = [
        trained(
            r.text.encode()
            for r in sample.filter(~F.col("purpose") & (F.col("toxic") == label)).orderBy(*order).select(head).collect()
        )
        for label in (1, 0)
    ]
    found = window_counts(sample.filter("purpose"), *dictionaries, ["toxic"]).collect()
    x = features(np.array([r["__counts"] for r in found]))
    y = np.array([r.toxic for r in found])
    share = sum(n for (label, _), n in counts.items() if label) / sum(counts.values())
    return ToxicityModel(*dictionaries, *fitted(x, y, share))


def score_toxicity(
    docs: DataFrame, model: ToxicityModel | None, columns: list[str], name: str = "score"
) -> DataFrame:
    """``columns`` of every row of ``docs`` with ``name``, the probability that it is toxic.

    Without a model every score is NOTHING_KNOWN.

    The score depends on the whole ``text`` alone. Null and empty texts have no windows and get the
    score that the model gives to such a text; a repeated row gets the same score as the first.
    """
    if model is None:
        return docs.select(*columns, F.lit(NOTHING_KNOWN).alias(name))
    counted = window_counts(docs, model.toxic, model.ordinary, columns)
    # The logistic model in column expressions; constants of the plan.
    x = [F.col("__counts")[i].cast("double") for i in range(HIGH - LOW + 1)]
    total = sum(x, F.lit(1.0))
    some = [c for i, c in enumerate(x) if i != -LOW]
    inputs = [*(F.log1p(c) for c in some), *(F.lit(100.0) * c / total for c in some), F.log(total)]
    margin = F.lit(float(model.weights[-1]))
    for c, centre, scale, weight in zip(inputs, model.centre, model.scale, model.weights):
        margin = margin + (c - F.lit(float(centre))) * F.lit(float(weight / scale))
    return counted.select(*columns, (F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))).alias(name))
