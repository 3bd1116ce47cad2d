"""BPE encoding and decoding: the distinct words of a batch are encoded along their trie.

A sequence of tokens is the encoding of its text if, and only if, each two neighbours are the
encoding of their own text. So the last token of a prefix determines the rest: it is the one suffix
of the prefix that is a token and fits to the last token of what stands before it. A node of the
trie holds that token; a word's encoding is read backwards along its path. The end of a word is a
symbol of its own (the last byte with the end-of-word mark), so it is tried at each word's end only.

The tokenizer file is read by the driver and broadcast (a vocabulary and its merges, some MB).
"""

import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.process import kept
from tidegate.llm.shared import texts
from tidegate.llm.trie import Memory, walk

#: Distinct words, and pairs of tokens, that a process remembers; about 250 bytes each.
REMEMBERED = 200_000
#: Bytes of the documents that are encoded together; their words take some ten times as much.
GROUP = 3_000_000


def packed_id(i: int) -> bytes:
    return i.to_bytes(4, "little")


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class BytePairs:
    """The model of a tokenizers file: BPE over bytes with an end-of-word suffix."""

    def __init__(self, content: bytes):
        file = json.loads(content)
        model, (split, _) = file["model"], file["pre_tokenizer"]["pretokenizers"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {(left, right): rank for rank, (left, right) in enumerate(merges)}
        self.pack = {token: packed_id(i) for token, i in self.ids.items()}
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        names = {i: t for t, i in (self.ids | self.special).items()}
        self.tokens = [names.get(i, "") for i in range(max(names) + 1)]
        self.longest = max(map(len, self.ids))
        space = r"\p{White_Space}"
        self.pieces = regex.compile(split["pattern"]["Regex"].replace(r"\s", space))
        self.space = regex.compile(rf"{space}+")
        self.parts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.characters = byte_characters()
        # Tokens that are the encoding of their own text.
        self.whole = {t for t in self.ids if self.merged(self.symbols(t)) == [t]}
        self.fits: dict[tuple[str, str], bool] = {}

    def symbols(self, token: str) -> list[str]:
        if token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def merged(self, symbols: list[str]) -> list[str]:
        """The symbols after all merges, the lowest rank first, the leftmost of equal ones."""
        never = len(self.ranks)
        while len(symbols) > 1:
            ranks = [self.ranks.get(pair, never) for pair in zip(symbols, symbols[1:])]
            least = min(ranks)
            if least == never:
                break
            at = ranks.index(least)
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    def fit(self, left: str, right: str) -> bool:
        """Whether two tokens are the encoding of their text."""
        both = [*self.symbols(left), *self.symbols(right)]
        found = self.fits[left, right] = self.merged(both) == [left, right]
        return found

    def encoded(self, words: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """Each distinct word, as byte characters, with its packed ids."""
        packed, whole, fits, fit, longest = (
            self.pack, self.whole, self.fits, self.fit, self.longest
        )

        def last(prefix: str, i: int, mark: str) -> tuple[str, int]:
            """The one token that ends the prefix and fits to the last one before it."""
            for length in range(1, min(i, longest) + 1):
                token = prefix[i - length : i] + mark
                if token in whole:
                    if length == i:
                        return token, length
                    left = states[i - length][0]
                    fitting = fits.get((left, token))
                    if fit(left, token) if fitting is None else fitting:
                        return token, length
            raise ValueError(f"No token ends {prefix[:i]!r}")

        if len(fits) > REMEMBERED:
            fits.clear()
        states: list[tuple[str, int]] = [("", 0)]
        for word in walk(words, states):
            # The last character of a word occurs with the mark only, unless another word goes on.
            for i in range(len(states), len(word)):
                states.append(last(word, i, ""))
            token, length = last(word, len(word), self.end)
            found, at = [packed[token]], len(word) - length
            while at:
                token, length = states[at]
                found.append(packed[token])
                at -= length
            found.reverse()
            yield word, b"".join(found)

    def packed(self, chunks: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """Each chunk between white space with its ids, packed."""
        cut, distinct, character = {}, set(), self.characters.__getitem__
        for chunk in chunks:
            pieces = [chunk] if chunk.isascii() and chunk.isalpha() else self.pieces.findall(chunk)
            cut[chunk] = [
                p if p.isascii() and p.isprintable() else "".join(map(character, p.encode()))
                for p in pieces
            ]
            distinct.update(cut[chunk])
        ids = dict(self.encoded(distinct))
        for chunk, pieces in cut.items():
            yield chunk, ids[pieces[0]] if len(pieces) == 1 else b"".join(map(ids.get, pieces))

    def chunks(self, text: str) -> list[str | int]:
        """Normalised pieces between white space, and ids of special tokens."""
        found: list[str | int] = []
        for part in self.parts.split(text) if "<|" in text else [text]:
            if part in self.special:
                found.append(self.special[part])
                continue
            if not part.isascii():
                # A sigma has the same lower case wherever it stands in a word.
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            part = part.lower()
            # str.split() also splits at U+001C to U+001F, which are no white space here.
            odd = any(c in part for c in "\x1c\x1d\x1e\x1f")
            found += (x for x in self.space.split(part) if x) if odd else part.split()
        return found

    def text(self, ids: list[int]) -> str:
        """What the file's decoder makes of the ids: it has none, so tokens with spaces between."""
        return " ".join([self.tokens[i] for i in ids])

    def decoded(self, packed: bytes) -> str:
        return self.text(np.frombuffer(packed, "<u4").tolist())


def _model(content) -> BytePairs:
    return kept(("byte pairs", hash(content.value)), lambda: BytePairs(content.value))


def _shared_file(df: DataFrame, path: str):
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def groups(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about ``most`` bytes together."""
    start = size = 0
    for at, text in enumerate(texts(batch)):
        if size and size + len(text) > most:
            yield batch.slice(start, at - start)
            start, size = at, 0
        size += len(text)
    if start < batch.num_rows:
        yield batch.slice(start)


def encode(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """Per row of ``docs`` ``(doc_id, n_tokens, ids)``: ids as little-endian unsigned 32-bit numbers.

    The ids are those of the tokenizers library for the file at ``path`` (read on the driver),
    without added special tokens; special tokens that a text spells out are theirs. Null texts are
    like empty ones: no ids. Rows are encoded one by one, whatever their doc_id; other columns are
    not read. There is no shuffle: each task walks the trie of its own words. ``decoded`` adds
    what ``decode`` makes of the ids, in the same pass.
    """
    content = _shared_file(docs, path)
    schema = "doc_id long, n_tokens long, ids binary" + ", decoded string" * decoded
    names = [part.split()[0] for part in schema.split(", ")]

    def encoded(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(content)
        memory = kept(("words", id(model)), lambda: Memory(model.packed, REMEMBERED))
        for batch in incoming:
            for part in groups(batch, GROUP):
                cut = [model.chunks(text.decode()) for text in texts(part)]
                known = memory.of({x for one in cut for x in one if type(x) is str})
                known |= {i: packed_id(i) for i in model.special.values()}
                ids = [b"".join(map(known.__getitem__, one)) for one in cut]
                del cut
                columns = [
                    part.column("doc_id"),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                ]
                if decoded:
                    columns.append(pa.array(map(model.decoded, ids), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encoded, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows with a column ``decoded``: the text of ``ids``, special tokens included.

    Null ids have a null text, no ids an empty one. An id that the file does not have is an error.
    """
    content = _shared_file(encoded, path)
    schema = encoded.select("*", F.lit("").alias("decoded")).schema
    schema["decoded"].nullable = True

    def decoded(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(content)
        for batch in incoming:
            ids = batch.column("ids").to_pylist()
            found = [None if one is None else model.decoded(one) for one in ids]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.string())],
                names=[*batch.schema.names, "decoded"],
            )

    return encoded.mapInArrow(decoded, schema)
