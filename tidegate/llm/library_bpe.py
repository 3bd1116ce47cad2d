"""Ids of the tokenizers library, by distinct words.

Texts are cut at white space, and the library encodes each distinct word that a process has not seen,
thousands in one call. That is valid for a file that drops white space and marks the ends of words,
which is checked.
"""

import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame

from tidegate.llm.bpe import groups
from tidegate.llm.process import kept
from tidegate.llm.shared import texts
from tidegate.llm.trie import Memory

#: Words that a process remembers (about 250 bytes each), and bytes of texts encoded together.
REMEMBERED, GROUP = 800_000, 6_000_000
#: Words in one call of the library.
CALL = 20_000
#: Stands between words in a call; words that hold it are encoded one by one.
MARK = "\0"


class LibraryEncoder:
    """Encodes texts word by word."""

    def __init__(self, content: bytes):
        file = json.loads(content)
        model, (split, _) = file["model"], file["pre_tokenizer"]["pretokenizers"]
        suffix = model["end_of_word_suffix"]
        if not suffix or not (split["behavior"] == "Removed" and split["invert"]):
            raise ValueError("Only files that drop white space and mark the ends of words can be used.")
        self.tokenizer = tokenizers.Tokenizer.from_str(content.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [x["content"] for x in file["added_tokens"]]
        ids = max([*model["vocab"].values(), *(x["id"] for x in file["added_tokens"])]) + 1
        self.ends = np.zeros(ids, bool)
        self.ends[[i for token, i in model["vocab"].items() if token.endswith(suffix)]] = True
        (self.mark,) = self.ids(MARK).tolist()
        self.parts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.space = regex.compile(r"\p{White_Space}+")

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def words(self, text: str) -> list[str]:
        """What stands between white space and special tokens, and those."""
        if "<|" in text:
            parts = self.parts.split(text)
            return [w for part in parts for w in ([part] if part in self.special else self._words(part))]
        return self._words(text)

    def _words(self, text: str) -> list[str]:
        # In lower case more words are equal, but "<|" may become the start of a special token.
        text = text.lower() if text.isascii() and "<|" not in text else text
        # str.split() also splits at U+001C to U+001F, which are no white space here.
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [x for x in self.space.split(text) if x]
        return text.split()

    def encoded(self, words: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """Each word with its ids, packed. Words of plain letters end where the first marked id does."""
        plain, others = [], []
        for word in words:
            (plain if word.isascii() and word.isalpha() else others).append(word)
        yield from self._together(plain, " ", lambda ids: np.flatnonzero(self.ends[ids]) + 1, 0)
        single = [w for w in others if MARK in w or w in self.special]
        others = [w for w in others if MARK not in w and w not in self.special]
        yield from self._together(
            others, f" {MARK} ", lambda ids: np.append(np.flatnonzero(ids == self.mark), len(ids)), 1
        )
        for word in single:
            yield word, self.ids(word).tobytes()

    def _together(
        self, words: list[str], between: str, ends: Callable[[np.ndarray], np.ndarray], skipped: int
    ) -> Iterator[tuple[str, bytes]]:
        for at in range(0, len(words), CALL):
            some = words[at : at + CALL]
            ids = self.ids(between.join(some))
            found = ends(ids)
            if len(found) != len(some):
                raise ValueError("The ids of words cannot be told apart with this file.")
            raw, start = ids.tobytes(), 0
            for word, end in zip(some, found.tolist()):
                yield word, raw[start : 4 * end]
                start = 4 * (end + skipped)


def shared_library_encoder(
    df: DataFrame, path: str
) -> Callable[[pa.RecordBatch], Iterator[tuple[pa.RecordBatch, list[bytes]]]]:
    """A function for tasks: slices of a batch, each with the packed ids of its texts.

    The file at ``path`` is read on the driver and broadcast (some MB). Null texts have no ids.
    """
    with open(path, "rb") as file:
        content = df.sparkSession.sparkContext.broadcast(file.read())

    def encode(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
        encoder = kept(("library", hash(content.value)), lambda: LibraryEncoder(content.value))
        memory = kept(("library words", id(encoder)), lambda: Memory(encoder.encoded, REMEMBERED))
        for part in groups(batch, GROUP):
            cut = [encoder.words(text.decode()) for text in texts(part)]
            known = memory.of({word for one in cut for word in one})
            yield part, [b"".join(map(known.__getitem__, one)) for one in cut]

    return encode
