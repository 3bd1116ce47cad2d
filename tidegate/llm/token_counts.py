"""Token counts under a unigram model: forward scores along the trie of distinct pre-tokens.

The best segmentation of a prefix ends in some piece, after the best segmentation of what stands
before the piece. So the best score of a prefix depends on the prefix alone: it is computed once
per node of the trie, and a pre-token's score and count are those of its last node.

Pieces and their order come from a SentencePiece file; as that holds ranks instead of
probabilities, a piece of rank r (from 1) is given the log-probability of Zipf's law, -ln(r), in
whole millionths. A character that no piece covers is spelled by its UTF-8 bytes.
"""

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.process import kept
from tidegate.llm.shared import texts
from tidegate.llm.trie import Memory, walk

#: Marks the start of a pre-token.
START = "▁"
#: Distinct pre-tokens whose counts a task remembers; about 150 bytes each.
REMEMBERED = 250_000


class Pieces:
    """The pieces of a unigram model with their scores, in millionths."""

    def __init__(self, pieces: list[str]):
        """``pieces``: the most frequent one first."""
        self.scores = {p: -round(1e6 * math.log(i + 1)) for i, p in enumerate(pieces)}
        #: The score of each byte of a character that no piece covers.
        self.byte = -round(1e6 * math.log(len(pieces) + 1)) - 10_000_000
        self.longest = max(map(len, self.scores))
        # Lengths of pieces by their last character: no others need to be tried.
        lengths: dict[str, set[int]] = {}
        for piece in self.scores:
            lengths.setdefault(piece[-1], set()).add(len(piece))
        self.lengths = {last: tuple(sorted(found)) for last, found in lengths.items()}

    @staticmethod
    def of_file(content: bytes) -> "Pieces":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=content)
        number = sorted(range(model.get_piece_size()), key=lambda i: (-model.get_score(i), i))
        odd = (model.is_control, model.is_unknown, model.is_unused, model.is_byte)
        return Pieces([model.id_to_piece(i) for i in number if not any(f(i) for f in odd)])

    def counted(self, words: Iterable[str]) -> Iterator[tuple[str, tuple[int, int]]]:
        """Each distinct word with the number of pieces and the score of its best segmentation.

        Of equal scores, that of fewer pieces is the best.
        """
        scores, lengths = self.scores, self.lengths
        # Score and number of pieces, negative so that more of either is better.
        states: list[tuple[int, int]] = [(0, 0)]
        marked = (START + word for word in words)
        for word in walk(marked, states):
            for i in range(len(states), len(word) + 1):
                last = word[i - 1]
                size = len(last.encode())
                score, number = states[i - 1]
                best = None if last in scores else (score + size * self.byte, number - size)
                for length in lengths.get(last, ()):
                    if length > i:
                        break
                    own = scores.get(word[i - length : i])
                    if own is not None:
                        score, number = states[i - length]
                        if best is None or (score + own, number - 1) > best:
                            best = score + own, number - 1
                states.append(best)
            score, number = states[-1]
            yield word[1:], (-number, score)


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """Per row of ``docs`` ``(doc_id, n_words, n_tokens, score)`` of the whole text.

    Pre-tokens are the runs between white space (Python's), each marked at its start. ``score`` is
    the log-probability of the best segmentation in millionths. Null and empty texts have no
    pre-tokens: all zero. Rows are counted one by one, whatever their doc_id; other columns are
    not read. There is no shuffle. ``path`` names a SentencePiece file, read on the driver.
    """
    with open(path, "rb") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())

    def counted(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = kept(("pieces", hash(content.value)), lambda: Pieces.of_file(content.value))
        memory = kept(("counts", id(pieces)), lambda: Memory(pieces.counted, REMEMBERED))
        for batch in incoming:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                cut = [text.decode().split() for text in texts(part)]
                known = memory.of({word for one in cut for word in one})
                rows = np.zeros((len(cut), 3), np.int64)
                for row, one in zip(rows, cut):
                    if one:
                        found = np.array([known[word] for word in one], np.int64)
                        row[:] = len(one), *found.sum(axis=0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(rows[:, i]) for i in range(3))],
                    names=["doc_id", "n_words", "n_tokens", "score"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(counted, "doc_id long, n_words long, n_tokens long, score long")
