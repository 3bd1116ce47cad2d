"""Depth-first walks over the trie of distinct words, within bounded memory.

Words in sorted order are the leaves of their trie in depth-first order. A walk keeps the states of
the nodes between the root and the current word; the next word starts at the node where the two
part, so the state of every shared prefix is computed once per walk.
"""

from collections.abc import Callable, Iterable, Iterator


def walk(words: Iterable[str], states: list) -> Iterator[str]:
    """Each distinct word, when ``states`` holds no more than the prefix it shares with the last.

    ``states`` has one entry per node of the path, that of the root first; the caller appends
    those of the word's other nodes.
    """
    before = ""
    for word in sorted(words):
        shared, most = 0, min(len(before), len(word))
        while shared < most and before[shared] == word[shared]:
            shared += 1
        del states[shared + 1 :]
        before = word
        yield word


class Memory:
    """Results by word, for one task: missing ones are computed together, old ones forgotten."""

    def __init__(self, compute: Callable[[list[str]], Iterable[tuple[str, object]]], most: int):
        self.compute, self.most, self.known = compute, most, {}

    def of(self, words: set[str]) -> dict:
        """A mapping that holds the results of these words."""
        missing = words.difference(self.known)
        if len(self.known) + len(missing) > self.most:
            self.known, missing = {}, words
        self.known.update(self.compute(missing))
        return self.known
