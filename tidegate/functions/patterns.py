"""Python regular expressions and Python text forms, evaluated by the JVM."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Syntax that Python accepts and Java reads differently or not at all.
_NOT_PORTABLE = {
    r"\(\?P[<=>]": "named groups (?P...)",
    r"\(\?\(": "conditional groups (?(...)...)",
    r"\(\?[a-zA-Z]*[aLu]": "the inline flags a, L and u",
    r"&&": "&& (a set intersection in Java)",
}


def java_pattern(pattern: str, anchored: bool) -> str:
    r"""The Java pattern that accepts the same text as Python's ``re.match`` (anchored) or
    ``re.search``.

    ``(?Ud)`` makes ``\w \d \s \b`` cover Unicode and ``\n`` the only line end, as in Python.
    """
    try:
        re.compile(pattern)
    except re.error as error:
        raise ValueError(f"Invalid pattern {pattern!r}: {error}") from error
    plain = re.sub(r"\\.", "", pattern, flags=re.DOTALL)
    for syntax, meaning in _NOT_PORTABLE.items():
        if re.search(syntax, plain):
            raise ValueError(f"Pattern {pattern!r} uses {meaning}, which Spark cannot evaluate.")
    inside_sets = re.findall(r"\[\^?\]?([^\]]*)\]", plain)
    if any("[" in chars for chars in inside_sets):
        raise ValueError(f"Pattern {pattern!r} has an unescaped '[' inside a set; write '\\['.")
    text = re.sub(r"(\\\\)|\\Z", lambda m: m.group(1) or r"\z", pattern)
    return f"(?Ud)^(?:{text})" if anchored else f"(?Ud)(?:{text})"


def matches_at_start(text: Column, pattern: str) -> Column:
    return text.rlike(java_pattern(pattern, anchored=True))


def matches_anywhere(text: Column, pattern: str) -> Column:
    return text.rlike(java_pattern(pattern, anchored=False))


def stripped(text: Column) -> Column:
    """The text without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"(?U)\S")


def _python_float(value: Column) -> Column:
    """Decimal text of a double, written as Python writes it."""
    size = F.abs(value)
    fixed = F.regexp_replace(value.cast("decimal(38,20)").cast("string"), r"(\.\d+?)0+$", "$1")
    java = value.cast("string")
    digits = F.regexp_replace(F.split_part(java, F.lit("E"), F.lit(1)), r"\.0$", "")
    power = F.split_part(java, F.lit("E"), F.lit(2)).cast("int")
    scientific = F.concat(
        digits, F.when(power < 0, "e-").otherwise("e+"),
        F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"),
    )
    return (
        F.when(F.isnan(value), F.lit("nan"))
        .when(size == float("inf"), F.when(value > 0, "inf").otherwise("-inf"))
        .when((size >= 1e-3) & (size < 1e7) | (size == 0), java)
        .when((size >= 1e-4) & (size < 1e16), fixed)
        .otherwise(scientific)
    )


def python_text(value: Column, dtype: T.DataType) -> Column:
    """The text that Python's ``str`` gives for the value; NULL stays NULL."""
    if isinstance(dtype, T.BooleanType):
        return F.when(value, "True").when(~value, "False")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(value.isNotNull(), _python_float(value.cast("double")))
    return value.cast("string")
