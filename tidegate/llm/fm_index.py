"""A bidirectional FM-index of a vocabulary, and searches for words that differ by one symbol.

The words, each behind a delimiter, are indexed twice: as they are and reversed. A pattern is known
by the interval of suffix ranks that start with it in the one index, and the interval of its reverse
in the other one. A symbol is put to either end of the pattern by rank counts in one index; how many
symbols in that interval are smaller moves the interval of the other along. So a search may start
at either end of a word. All functions take arrays: many patterns go the same step together.

Words are told apart by the suffix ranks of their delimiters, which follow the order of the words.
"""

from dataclasses import dataclass

import numpy as np

#: Rows between two checkpoints of the counts.
BLOCK = 32
#: Intervals of at most so many ranks are read; of wider ones the counts name the symbols.
NARROW = 48


class Ranks:
    """The last column of the sorted suffixes of delimited words, with counts of its symbols.

    Symbol 0 is the delimiter; ``words`` are in ascending order, the symbols of all in ``flat``.
    """

    def __init__(self, flat: np.ndarray, lengths: np.ndarray, symbols: int):
        number = len(lengths)
        text = np.zeros(len(flat) + number + 1, np.uint8 if symbols < 256 else np.int32)
        starts = np.cumsum(lengths + 1) - lengths
        letters = np.ones(len(text), bool)
        letters[np.r_[starts - 1, len(text) - 1]] = False
        text[letters] = flat
        order = self._sorted(text, letters, number)
        column = text[order - 1]
        # One block more than there are rows for: the counts before it are those of all rows.
        blocks = len(column) // BLOCK + 2
        padded = np.full(blocks * BLOCK, symbols, text.dtype)
        padded[: len(column)] = column
        self.column, self.blocks = column, padded.reshape(blocks, BLOCK)
        at = np.arange(blocks).repeat(BLOCK)[: len(column)]
        counts = np.bincount(at * symbols + column, minlength=blocks * symbols).reshape(blocks, symbols)
        before = np.zeros((blocks, symbols + 1), np.int32)
        np.cumsum(counts, axis=1, out=before[:, 1:])
        #: Symbols smaller than each one before each block.
        self.smaller = np.cumsum(before, axis=0, dtype=np.int32) - before
        self.first = np.r_[0, np.cumsum(counts.sum(axis=0))]
        self.symbols = symbols

    @staticmethod
    def _sorted(text: np.ndarray, letters: np.ndarray, number: int) -> np.ndarray:
        """The suffixes in order, by doubling; delimiters rank as the words behind them do."""
        rank = text.astype(np.int64) + number
        rank[~letters] = np.r_[1 : number + 1, 0]
        width, last, span = 1, len(text) - 1, len(text) + number + int(text.max()) + 2
        while True:
            ahead = rank[np.minimum(np.arange(len(text)) + width, last)]
            key = rank * span + ahead
            order = np.argsort(key, kind="stable")
            new = np.r_[False, key[order[1:]] != key[order[:-1]]]
            rank = np.empty(len(text), np.int64)
            rank[order] = np.cumsum(new)
            if rank[order[-1]] == last:
                return order
            width *= 2

    def counts(self, symbol: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many symbols above ``row`` are smaller than ``symbol``, and equal to it."""
        block, inside = np.divmod(row, BLOCK)
        rows = self.blocks[block]
        own = symbol[:, None].astype(rows.dtype)
        above = np.arange(BLOCK) < inside[:, None]
        smaller = self.smaller[block, symbol]
        equal = self.smaller[block, symbol + 1] - smaller
        return (
            smaller + ((rows < own) & above).sum(axis=1),
            equal + ((rows == own) & above).sum(axis=1),
        )

    def present(self, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(pattern, symbol)``: what stands in each interval; of wide ones, what may stand there."""
        wide = np.flatnonzero(size > NARROW)
        found = []
        if len(wide):
            top = self.smaller[low[wide] // BLOCK]
            end = self.smaller[(low[wide] + size[wide] - 1) // BLOCK + 1]
            pattern, symbol = np.nonzero(np.diff(end - top, axis=1) > 0)
            found.append((wide[pattern], symbol))
        narrow = np.flatnonzero(size <= NARROW)
        sizes = size[narrow]
        pattern = np.repeat(narrow, sizes)
        row = np.arange(len(pattern)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[pattern]
        key = np.unique(pattern * self.symbols + self.column[row])
        found.append((key // self.symbols, key % self.symbols))
        pattern, symbol = (np.concatenate(part) for part in zip(*found))
        return pattern, symbol


@dataclass
class Patterns:
    """Patterns by their intervals: in the index that extends them, and in the other one."""

    query: np.ndarray
    next: np.ndarray
    own: np.ndarray
    other: np.ndarray
    size: np.ndarray

    def take(self, chosen: np.ndarray, **changed: np.ndarray) -> "Patterns":
        return Patterns(**{k: v[chosen] for k, v in vars(self).items()} | changed)

    def extended(self, ranks: Ranks, symbol: np.ndarray) -> "Patterns":
        """Each pattern with one more symbol; those that no word holds are left out."""
        above, before = ranks.counts(symbol, self.own)
        below, end = ranks.counts(symbol, self.own + self.size)
        size = end - before
        found = Patterns(
            self.query, self.next, ranks.first[symbol] + before, self.other + below - above, size
        )
        return found.take(size > 0)

    @staticmethod
    def together(parts: list["Patterns"]) -> "Patterns":
        return Patterns(*(np.concatenate(c) for c in zip(*(vars(p).values() for p in parts))))


class Vocabulary:
    """The bidirectional index of distinct words, given in ascending order.

    ``alphabet`` holds the code points of words and queries in ascending order.
    """

    def __init__(self, words: list[str], alphabet: np.ndarray):
        self.alphabet, self.words = alphabet, words
        self.forward = Ranks(*self.coded(words), len(alphabet) + 1)
        self.backward = Ranks(*self.coded(sorted(w[::-1] for w in words)), len(alphabet) + 1)

    def coded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        lengths = np.array([len(w) for w in words], np.int64)
        return np.searchsorted(self.alphabet, points) + 1, lengths

    def near(self, queries: list[str], left: bool) -> tuple[np.ndarray, np.ndarray]:
        """``(query, word)`` numbers of words that differ by one inserted, deleted or replaced symbol.

        ``left``: those that agree with the left half (the shorter one) of the query, which is
        matched first, and then the right half with the one error. Else the right half is matched
        first, from the end, and those that agree with the left half as well are left out.
        """
        flat, lengths = self.coded(queries if left else [q[::-1] for q in queries])
        exact = lengths // 2 if left else lengths - lengths // 2
        ranks = self.backward if left else self.forward
        starts = np.cumsum(lengths) - lengths
        flat = np.r_[flat, 0]

        def symbols(query: np.ndarray, at: np.ndarray) -> np.ndarray:
            """The symbol of a query at a place; the delimiter behind its end."""
            return np.where(at < lengths[query], flat[np.minimum(starts[query] + at, len(flat) - 1)], 0)

        number = np.arange(len(queries))
        zero = np.zeros(len(queries), np.int64)
        plain = Patterns(number, zero, zero, zero, np.full(len(queries), len(self.words) + 1))
        found: list[Patterns] = []
        erring: list[Patterns] = []
        while len(plain.query) or erring:
            ahead = symbols(plain.query, plain.next)
            free = plain.next >= exact[plain.query]
            parts = [self._errors(ranks, plain.take(free), ahead[free], symbols), *erring]
            # The plain patterns go one symbol on; a whole query is no word that differs from it.
            plain = plain.take(ahead > 0, next=plain.next[ahead > 0] + 1).extended(ranks, ahead[ahead > 0])
            late = Patterns.together(parts)
            ahead = symbols(late.query, late.next)
            late = late.take(slice(None), next=late.next + 1)
            late.next[ahead == 0] = -1
            late = late.extended(ranks, ahead)
            done = late.next < 0
            found.append(late.take(done))
            erring = [late.take(~done)] if not done.all() else []
        done = Patterns.together(found) if found else plain
        # The delimiter of the first word has rank 1; rank 0 is the one behind all words.
        word = (done.other if left else done.own) - 1
        query, word = np.divmod(np.unique(done.query * len(self.words) + word), len(self.words))
        if not left:
            halves = (queries[q][: len(queries[q]) // 2] for q in query.tolist())
            other = np.array([not self.words[w].startswith(h) for w, h in zip(word.tolist(), halves)], bool)
            query, word = query[other], word[other]
        return query, word

    @staticmethod
    def _errors(ranks: Ranks, plain: Patterns, ahead: np.ndarray, symbols) -> Patterns:
        """The patterns with an error at their next place; what equals another one is left out."""
        behind = symbols(plain.query, plain.next + 1)
        # Of a run of equal symbols the last one is deleted, and one is inserted behind the run.
        deleted = (ahead > 0) & (ahead != behind)
        parts = [plain.take(deleted, next=plain.next[deleted] + 1)]
        pattern, symbol = ranks.present(plain.own, plain.size)
        other = (symbol > 0) & (symbol != ahead[pattern])
        pattern, symbol = pattern[other], symbol[other]
        changed = plain.take(pattern)
        inside = ahead[pattern] > 0
        grown = Patterns(
            np.arange(len(pattern)), changed.next, changed.own, changed.other, changed.size
        ).extended(ranks, symbol)
        origin = grown.query
        inserted = grown.take(slice(None), query=changed.query[origin])
        replaced = inside[origin]
        parts += [inserted, inserted.take(replaced, next=inserted.next[replaced] + 1)]
        return Patterns.together(parts)


def alphabet_of(words: list[str]) -> np.ndarray:
    return np.unique(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32))
