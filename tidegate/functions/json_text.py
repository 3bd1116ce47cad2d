"""JSON text as VARIANT values."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _seal(text: Column) -> Column:
    return F.xxhash64(text).cast("string")


def _sealed(text: Column) -> Column:
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), _seal(text), F.lit('"]')))


def _opened(sealed: Column, text: Column) -> Column:
    intact = F.try_variant_get(sealed, "$[1]", "string") == _seal(text)
    return F.when(intact, F.try_variant_get(sealed, "$[0]", "variant"))


def parse_json_strict(text: Column) -> Column:
    """The VARIANT of a JSON text, or NULL if the text is not exactly one JSON value.

    ``try_parse_json`` alone stops at the end of the first value and accepts whatever follows.
    The text is therefore parsed as the first element of an array that ends in a hash of the
    text: trailing characters spoil the array or push the hash out of second place.
    """
    return _opened(_sealed(text), text)


def with_json_values(df: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """Add :func:`parse_json_strict` of several texts as columns, each parsed once per row."""
    sealed = df.withColumns({f"_sealed_{name}": _sealed(text) for name, text in texts.items()})
    opened = {name: _opened(F.col(f"_sealed_{name}"), text) for name, text in texts.items()}
    return sealed.withColumns(opened).drop(*[f"_sealed_{name}" for name in texts])


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column so that a later filter on it does not compute it again.

    Spark pushes a filter below a projection by repeating the projected expression; it leaves
    the output of a generator alone.
    """
    once = F.explode(F.array("_once")).alias(name)
    return df.withColumn("_once", value).select("*", once).drop("_once")


def variant_entries(value: Column) -> Column:
    """``map<string, variant>`` of a VARIANT object, NULL for anything else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def variant_items(value: Column) -> Column:
    """``array<variant>`` of a VARIANT array, NULL for anything else."""
    return F.try_variant_get(value, "$", "array<variant>")


def json_literal(text: str) -> Column:
    """Normal form of a JSON literal, comparable with ``to_json`` of a VARIANT."""
    return F.to_json(F.parse_json(F.lit(text)))
