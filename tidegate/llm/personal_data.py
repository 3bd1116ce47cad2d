"""Personal data: fixed patterns, and contexts that bootstrap more.

Four kinds are found by fixed patterns. Their values are the seeds of a bootstrap: the words around
a value are its lexical patterns, and a pattern under which nearly all values are known to be of
one kind is taken to announce that kind. Unknown values, tokens with a digit, that stand under such
patterns become known in turn. Patterns and values are two sides of a graph, which Spark scores in
rounds until no value is added.
"""

import re
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.shared import NO_ID, stored, texts

KINDS = ("email", "ip", "card", "phone")

_DIGIT = re.compile("[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A run of digits that no point follows has no match at a later digit either.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: A whole token that may be an identifier, and the words beside it.
_INNER = r"\s\"'<>(),;"
_TOKEN = re.compile(rf"(?<![^{_INNER}])[^{_INNER}0-9]*+[0-9][^{_INNER}]*+")
_WORD = re.compile(r"\S+")
#: Characters looked at on either side for the words of a pattern.
_BESIDE = 64


def emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    total = 0
    for i, digit in enumerate(map(int, reversed(digits))):
        total += digit if i % 2 == 0 else digit * 2 - 9 * (digit > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of what the fixed patterns find, by kind and start."""
    found = [(0, *span) for span in emails(text)]
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                found.append((3, *m.span()))
    return found


def contexts(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple]:
    """``(kind, start, end, value, patterns)`` of each base span, and with kind -1 of each other
    token with a digit. Patterns: two words before; the word before and the one after."""
    taken = sorted((start, end) for _, start, end in spans)
    places = [*spans]
    at = 0
    for m in _TOKEN.finditer(text) if _DIGIT.search(text) else ():
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if len(m[0]) >= 4 and not (at < len(taken) and taken[at][0] < m.end()):
            places.append((-1, *m.span()))
    for kind, start, end in places:
        left = _WORD.findall(text[max(0, start - _BESIDE) : start].lower())[-2:]
        right = _WORD.findall(text[end : end + _BESIDE].lower())[:1]
        patterns = []
        if len(left) == 2:
            patterns.append(" ".join(["<", *left]))
        if left and right:
            patterns.append(" ".join(["<>", left[-1], right[0]]))
        yield kind, start, end, text[start:end].lower(), patterns


SPAN = "struct<kind:int,start:int,end:int>"
PLACE = "struct<kind:int,start:int,end:int,value:string,patterns:array<string>>"


def _found(docs: DataFrame) -> DataFrame:
    """Base spans and places with their patterns, of each row."""
    span = [("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]
    place = pa.struct([*span, ("value", pa.string()), ("patterns", pa.list_(pa.string()))])
    names = [n for n, _ in span]
    rows = docs.select(
        F.col("doc_id").cast("long"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64("text").alias("version"),
        "text",
    )

    def found(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            base, places = [], []
            for content in texts(batch):
                text = content.decode()
                spans = base_spans(text)
                base.append([dict(zip(names, s)) for s in spans])
                places.append(
                    [dict(zip([*names, "value", "patterns"], p)) for p in contexts(text, spans)]
                )
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "doc", "version")),
                    pa.array(base, pa.list_(pa.struct(span))),
                    pa.array(places, pa.list_(place)),
                ],
                names=["doc_id", "doc", "version", "base", "places"],
            )

    schema = f"doc_id long, doc long, version long, base array<{SPAN}>, places array<{PLACE}>"
    return rows.mapInArrow(found, schema)


def discovered(places: DataFrame, support: int, confidence: float) -> DataFrame:
    """``(value, kind)`` of the values that patterns add, from ``(kind, value, patterns)``.

    In each round a pattern's confidence in a kind is the share of its different values that are
    known to be of that kind; it counts with ``support`` known values at least. A value's score is
    1 - (1 - c1)(1 - c2)... over the confidences of its patterns in the kind; the best kind of a
    score of at least ``confidence`` makes it known. Values of a common pattern are counted after
    partial aggregation; patterns and values are joined after that.
    """
    edges = stored(
        places.select("kind", "value", F.explode("patterns").alias("pattern")).distinct(), "edges"
    )
    known = edges.filter("kind >= 0").groupBy("value").agg(F.min("kind").alias("kind"))
    known = stored(known.withColumn("round", F.lit(0)), "known_values")
    links = edges.select("value", "pattern").distinct()
    links = stored(links, "pattern_values")
    sizes = stored(links.groupBy("pattern").agg(F.count("*").alias("values")), "pattern_sizes")
    for turn in count(1):
        scores = (
            links.join(known, "value")
            .groupBy("pattern", "kind")
            .agg(F.count("*").alias("hits"))
            .join(sizes, "pattern")
            .withColumn("score", F.col("hits") / F.col("values"))
            .filter((F.col("hits") >= support) & (F.col("score") >= confidence) & (F.col("score") < 1))
        )
        added = (
            links.join(scores.select("pattern", "kind", "score"), "pattern")
            .join(known.select("value"), "value", "left_anti")
            .groupBy("value", "kind")
            .agg((1 - F.exp(F.sum(F.log(1 - F.col("score"))))).alias("score"))
            .filter(F.col("score") >= confidence)
            .groupBy("value")
            .agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
        )
        added = stored(added.withColumn("round", F.lit(turn)), "added_values")
        if added.isEmpty():
            break
        known = known.union(added)
    return known.filter("round > 0").select("value", F.col("kind").alias("found"))


def personal_data(
    docs: DataFrame, support: int = 5, confidence: float = 0.8
) -> DataFrame:
    """Per row of ``docs`` ``(doc_id, base, spans)``: arrays of ``(kind, start, end)``, kinds by number.

    ``base`` holds what the fixed patterns find in the whole text, ``spans`` also what the
    bootstrap adds; both are sorted by kind and start, in code points, the end exclusive. Null and
    empty texts have no spans. Each row returns, rows that repeat a text with the same spans. A
    value that its patterns announce is found wherever it stands, whatever its context there. Other
    columns are not read. Rounds go on until one adds no
    value.
    """
    rows = stored(_found(docs), "personal_places")
    places = rows.select("doc", "version", F.explode("places").alias("p"))
    places = places.select("doc", "version", "p.*")
    values = discovered(places.select("kind", "value", "patterns"), support, confidence)
    more = (
        places.filter("kind < 0")
        .join(values, "value")
        .select("doc", "version", F.expr("struct(found AS kind, start, end)").alias("span"))
        .groupBy("doc", "version")
        .agg(F.collect_set("span").alias("more"))
    )
    return rows.join(more, ["doc", "version"], "left").select(
        "doc_id",
        F.array_sort("base").alias("base"),
        F.array_sort(
            F.concat("base", F.coalesce("more", F.expr(f"CAST(array() AS array<{SPAN}>)")))
        ).alias("spans"),
    )
