"""Benchmark decontamination by templates: re-parameterised questions match as well as copies.

Texts become templates: every number, every capitalised word and every unit after a number is a
placeholder of its type, all else a lower-case word. Windows of template tokens of the benchmark
items are joined by their hashes with those of the documents. A document is contaminated by an item
if the windows that it shares cover enough of the item, and if the values behind the placeholders
agree: equal values of the item stand for equal values of the document, and different ones for
different ones, with few exceptions. That is judged for each occurrence of the item, as a document
may hold it several times with other values. Items are also looked for with their capitalised words
as plain words, as a document may have them in capitals or in lower case throughout, and by windows
of their tokens as they stand, which find copies of items that are mostly numbers or names.

Only column functions are used. Windows of documents meet those of the benchmark without a shuffle
while the benchmark is small (its windows are counted); beyond that they are a sorted join.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.shared import BROADCAST_ROWS, NO_ID, broadcast_if_small, stored

NUMBER, NAME, UNIT = "0", "1", "2"
#: A token: a number with its inner marks, or a run of letters.
TOKEN = r"\p{N}+(?:[.,:/]\p{N}+)*|\p{L}+"
#: What counts as a unit when it follows a number.
UNITS = (
    "mm cm dm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres"
    " mg g kg t lb lbs oz gram grams pound pounds ounce ounces ton tons"
    " ml cl dl l liter liters litre litres gallon gallons cup cups"
    " ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months"
    " year years mph kmh hz khz mhz ghz w kw kwh v a j kj cal kcal degrees percent"
    " cent cents dollar dollars euro euros usd eur gbp pounds yen"
).split()


def template(text: Column) -> Column:
    """The template tokens of a text, one for each match of TOKEN."""
    text = F.regexp_replace(text, r"\p{N}+(?:[.,:/]\p{N}+)*", f" {NUMBER} ")
    text = F.regexp_replace(text, r"(?<!\p{L})\p{Lu}\p{Ll}\p{L}*", f" {NAME} ")
    return _split(text)


def plain(text: Column) -> Column:
    """The tokens of a text with capitalised words in lower case."""
    return _split(F.regexp_replace(text, r"\p{N}+(?:[.,:/]\p{N}+)*", f" {NUMBER} "))


def _split(text: Column) -> Column:
    units = rf"{NUMBER}([^\p{{L}}\p{{N}}]+)(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])"
    text = F.regexp_replace(F.lower(text), units, f"{NUMBER} {UNIT} ")
    return F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda x: x != "")


def literal(text: Column) -> Column:
    """The tokens of a text as they are, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _windows(tokens: str, width: int, salt: str = "") -> Column:
    """``(at, hash)`` of each window of so many tokens; none for fewer tokens."""
    return F.expr(f"""IF(size({tokens}) >= {width},
        transform(sequence(0, greatest(size({tokens}) - {width}, 0)),
            i -> xxhash64(slice({tokens}, i + 1, {width}){salt})),
        CAST(array() AS array<bigint>))""")


#: Keeps the hashes of literal windows apart from those of templates.
LITERAL = ", 'literal'"


def _items(benchmark: DataFrame, width: int, shortest: int, literals: int) -> DataFrame:
    """``(item, at, hash, width)``: the windows of the items, of either form and of literal tokens."""
    forms = F.array(template(F.col("text")), plain(F.col("text")), literal(F.col("text")))
    rows = benchmark.select(F.col("item_id").alias("item"), F.posexplode(forms).alias("form", "tokens"))
    rows = rows.filter(F.size("tokens") >= shortest).withColumn(
        "width", F.least(F.size("tokens"), F.lit(width))
    )
    starts = F.expr("sequence(0, size(tokens) - width)")
    rows = rows.select("*", F.explode(starts).alias("at"))
    window = F.expr("slice(tokens, at + 1, width)")
    words = F.size(F.filter(window, lambda x: ~x.isin(NUMBER, NAME, UNIT)))
    exact = F.col("form") == 2
    hashed = F.when(exact, F.expr(f"xxhash64(slice(tokens, at + 1, width){LITERAL})")).otherwise(F.xxhash64(window))
    return (
        rows.filter(exact | (words >= F.least(F.lit(literals), F.col("width"))))
        .select("item", "at", hashed.alias("hash"), "width")
        .distinct()
    )


def _occurrences(shared: DataFrame) -> DataFrame:
    """``(doc, version, item, covered, runs)`` of what may be one occurrence of an item.

    These are the runs of one alignment (the place in the text less that in the item), those of
    neighbouring alignments, as a text may have words more or less, and all runs of the text.
    """
    own = ["doc", "version", "item"]
    runs = shared.select(*own, F.size("kinds").alias("length"), F.explode("runs").alias("run"))
    runs = runs.withColumn("place", F.col("run.q") - F.col("run.p"))
    by_place = Window.partitionBy(*own).orderBy("place")
    apart = F.col("place") - F.lag("place").over(by_place) > F.ceil(F.col("length") / 4)
    runs = runs.withColumn("apart", F.coalesce(apart, F.lit(False)).cast("int"))
    runs = runs.withColumn("near", F.sum("apart").over(by_place))
    ways = F.array(
        *(F.struct(F.lit(i).alias("way"), c.cast("long").alias("at"))
          for i, c in enumerate((F.col("place"), F.col("near"), F.lit(0))))
    )
    runs = runs.select(*own, "run", F.explode(ways).alias("way"))
    spans = F.expr("flatten(collect_set(sequence(run.p, run.p + run.width - 1)))")
    return (
        runs.groupBy(*own, "way")
        .agg(F.size(F.array_distinct(spans)).alias("covered"), F.collect_set("run").alias("runs"))
        .drop("way")
    )


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = 8,
    coverage: float = 0.5,
    agreement: float = 0.85,
    shortest: int = 5,
    literals: int = 3,
) -> DataFrame:
    """``(doc_id, item_id, coverage, n_slots, agreement, verbatim)`` of each contaminated document.

    Windows have ``width`` tokens, or all of a shorter item; those of templates have at least
    ``literals`` words that are no placeholders. ``coverage`` is the share of the item's tokens in
    shared windows. Of the different pairs of values that stand for each other, ``agreement`` is the
    least share that one of each value makes. Both are judged for each occurrence of the item, of
    which one has to pass; the row has the greatest values. ``verbatim``: all values of an
    occurrence are the same but for case. One row per document and item, for whole texts. Items of fewer than ``shortest`` tokens or without an id, null and
    empty texts match nothing. A null doc_id is a document like any other; rows that repeat a document
    or an item give no further rows. Other columns are not read.
    """
    items = benchmark.select(F.col("item_id").cast("long"), "text")
    items = items.filter("item_id IS NOT NULL AND text IS NOT NULL")
    windows = stored(_items(items, width, shortest, literals).withColumnRenamed("at", "p"), "item_windows")
    widths = [r[0] for r in windows.select("width").distinct().collect()]  # at most ``width`` values
    small = windows.count() <= BROADCAST_ROWS

    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64("text").alias("version"),
        "text",
    ).filter("text IS NOT NULL")
    tokens = rows.select(
        "doc", "version", template(F.col("text")).alias("tokens"), literal(F.col("text")).alias("words")
    )
    hits = None
    for one in widths:
        wanted = windows.filter(F.col("width") == one)
        both = F.array(_windows("tokens", one), _windows("words", one, LITERAL))
        found = tokens.select("doc", "version", F.explode(both).alias("hashes"))
        found = found.select("doc", "version", F.posexplode("hashes").alias("q", "hash"))
        found = found.join(F.broadcast(wanted) if small else wanted, "hash")
        hits = found if hits is None else hits.union(found)
    if hits is None:
        hits = tokens.select("doc", "version", F.lit(0).alias("q"), F.lit(0).cast("long").alias("hash"))
        hits = hits.join(windows, "hash")

    lengths = items.select(F.col("item_id").alias("item"), template(F.col("text")).alias("kinds"),
                           F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("values"))
    lengths = lengths.distinct()
    spans = F.expr("flatten(collect_set(sequence(p, p + width - 1)))")
    shared = hits.groupBy("doc", "version", "item").agg(
        F.size(F.array_distinct(spans)).alias("covered"),
        F.collect_set(F.struct("p", "q", "width")).alias("runs"),
    )
    shared = shared.join(lengths, "item").withColumn(
        "coverage", F.col("covered") / F.size("kinds")
    )
    shared = stored(shared.filter(F.col("coverage") >= coverage), "shared_windows")
    shared = _occurrences(shared).join(broadcast_if_small(stored(lengths, "item_values")), "item")
    shared = shared.withColumn("coverage", F.col("covered") / F.size("kinds"))
    shared = stored(shared.filter(F.col("coverage") >= coverage), "occurrences")

    ids = stored(shared.select("doc", "version").distinct(), "shared_documents")
    texts = rows.join(broadcast_if_small(ids), ["doc", "version"], "left_semi").distinct()
    texts = texts.select(
        "doc", "version", F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("tokens")
    )
    # Which values stand for each other, where the item has a placeholder.
    slots = F.expr(f"""array_distinct(flatten(transform(runs, r ->
        transform(filter(sequence(0, r.width - 1),
                         o -> get(kinds, r.p + o) IN ('{NUMBER}', '{NAME}', '{UNIT}')),
            o -> struct(get(kinds, r.p + o) AS kind, lower(get(values, r.p + o)) AS mine,
                        lower(get(tokens, r.q + o)) AS theirs)))))""")
    found = shared.join(texts, ["doc", "version"]).withColumn("slots", slots)
    number = F.size("slots")
    mine = F.size(F.expr("array_distinct(transform(slots, s -> struct(s.kind, s.mine)))"))
    theirs = F.size(F.expr("array_distinct(transform(slots, s -> struct(s.kind, s.theirs)))"))
    agree = F.when(number == 0, 1.0).otherwise(F.least(mine, theirs) / number)
    return (
        found.withColumn("agreement", agree)
        .filter(F.col("agreement") >= agreement)
        .groupBy(F.nullif(F.col("doc"), F.lit(NO_ID)).alias("doc_id"), F.col("item").alias("item_id"))
        .agg(
            F.max("coverage").alias("coverage"),
            F.max(number).cast("long").alias("n_slots"),
            F.max("agreement").alias("agreement"),
            F.max(F.expr("forall(slots, s -> s.mine = s.theirs)")).alias("verbatim"),
        )
    )
