"""Best-fit packing by minimum bin slack: the fullest combination of lengths, again and again.

How well documents fit together depends on their lengths only, and a sequence of ``size`` tokens
leaves ``size - 1`` different ones. So the plan is made from a table of counts by length, which has
that many rows however many documents there are: the longest length left opens a sequence, dynamic
programming over a bitset of reachable sums finds the lengths left that fill it best, and the
combination is removed as often as the counts allow (until then it stays the fullest one).

A combination is taken until a length has fewer pieces left than it takes, so a length ends at most
``1 + size / length`` combinations: below 40,000 in all for 4,096 tokens. The plan is broadcast.
The pieces of a length are numbered in buckets, and each finds its place in the plan by its number:
no task holds a length, and no document is moved.
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.hash_tree import number_slots
from tidegate.llm.library_bpe import shared_library_encoder
from tidegate.llm.shared import stored

#: Bits of a number below those of its length in the keys of a plan.
NUMBER = 45


def fullest(counts: np.ndarray, room: int) -> list[tuple[int, int]]:
    """``(length, times)`` of the lengths that fill ``room`` best, each taken at most its count.

    Sums are the bits of an integer; ``reached`` keeps them after every step, for the way back.
    Longer lengths come first and the steps end when the room is filled, so short pieces stay for
    the gaps that only they can fill.
    """
    lengths = np.flatnonzero(counts[: room + 1])[::-1].tolist()
    mask = (1 << (room + 1)) - 1
    reached, steps, sums = [], [], 1
    for length in lengths:
        left = min(int(counts[length]), room // length)
        times = 1
        while left and not sums >> room:
            times = min(times, left)
            reached.append(sums)
            steps.append((length, times))
            sums |= sums << (length * times) & mask
            left -= times
            times *= 2
        if sums >> room:
            break
    total, taken = sums.bit_length() - 1, {}
    for before, (length, times) in zip(reversed(reached), reversed(steps)):
        if not before >> total & 1:
            total -= length * times
            taken[length] = taken.get(length, 0) + times
    return sorted(taken.items(), reverse=True)


@dataclass(frozen=True)
class Plan:
    """Where the pieces of each length go, by their numbers; sorted by ``key``.

    From the number in ``key`` on, ``times`` pieces at a time go to sequences from ``sequence`` on,
    one behind the other from ``offset``.
    """

    key: np.ndarray
    times: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length << NUMBER) + number
        at = np.searchsorted(self.key, key, "right") - 1
        within = key - self.key[at]
        place = self.offset[at] + within % self.times[at] * length
        return self.sequence[at] + within // self.times[at], place


def packing_plan(counts: np.ndarray, size: int) -> Plan:
    """The plan for ``counts[length]`` pieces of each length up to ``size``."""
    counts = counts.copy()
    used = np.zeros_like(counts)
    rows, sequence, longest = [], 0, size
    while longest:
        if not counts[longest]:
            longest -= 1
            continue
        counts[longest] -= 1
        rest = dict(fullest(counts, size - longest))
        counts[longest] += 1
        rest[longest] = rest.get(longest, 0) + 1
        again = min(int(counts[length]) // times for length, times in rest.items())
        offset = 0
        for length, times in sorted(rest.items(), reverse=True):
            rows.append(((length << NUMBER) + int(used[length]), times, sequence, offset))
            used[length] += again * times
            counts[length] -= again * times
            offset += length * times
        sequence += again
    columns = np.array(sorted(rows), np.int64).reshape(-1, 4).T
    return Plan(*(np.ascontiguousarray(c) for c in columns))


def token_pieces(docs: DataFrame, path: str, size: int = 4096, end: int = 1) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: the ids of every text and ``end``, cut at ``size``.

    The ids are those of the tokenizers library for the file at ``path``. A null text is an empty
    one: the end token alone. ``ids_crc32`` is that of the ids as little-endian 32-bit numbers.
    """
    encoder = shared_library_encoder(docs, path)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    last = end.to_bytes(4, "little")

    def pieces(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            for part, found in encoder(batch):
                rows = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), found):
                    ids += last
                    for piece, at in enumerate(range(0, len(ids), 4 * size)):
                        one = ids[at : at + 4 * size]
                        rows.append((doc, piece, at // 4, len(one) // 4, zlib.crc32(one)))
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, schema)


def pack(pieces: DataFrame, size: int = 4096) -> DataFrame:
    """The rows with ``sequence_id`` and ``offset``: few sequences of at most ``size`` tokens.

    ``pieces`` has ``length`` (1 to ``size``) and columns that tell rows apart; columns named like
    the added ones are replaced. Equal rows are pieces of their own. No rows give no rows. The rows
    are read twice, so pass a table that is stored.
    """
    counted = pieces.groupBy("length").count().collect()
    if any(r.length is None or not 0 < r.length <= size for r in counted):
        raise ValueError(f"Lengths have to be 1 to {size}.")
    counts = np.zeros(size + 1, np.int64)
    for r in counted:
        counts[r.length] = r["count"]
    plan = packing_plan(counts, size)
    shared = pieces.sparkSession.sparkContext.broadcast(plan)
    pieces = pieces.drop("sequence_id", "offset")
    order = [c for c in pieces.columns if c != "length"]
    numbered = number_slots(pieces, "length", order, "__number")
    schema = pieces.withColumns({c: F.lit(0).cast("long") for c in ("sequence_id", "offset")}).schema
    own_columns, names = pieces.columns, schema.names

    def placed(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in incoming:
            length, number = (batch.column(c).to_numpy() for c in ("length", "__number"))
            sequence, offset = own.place(length, number)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in own_columns), pa.array(sequence), pa.array(offset)],
                names=names,
            )

    return numbered.select(*own_columns, "__number").mapInArrow(placed, schema)


def pack_documents(docs: DataFrame, path: str, size: int = 4096, end: int = 1) -> DataFrame:
    """Packs every text of ``docs (doc_id, text)``, cut only where it is longer than a sequence.

    Rows are packed one by one, whatever their doc_id (null included); repeated rows are pieces of
    their own; other columns are not read. An empty table gives an empty one.
    """
    return pack(stored(token_pieces(docs, path, size, end), "token_pieces"), size)
