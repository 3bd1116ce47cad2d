"""Rows to JSON text by a template whose slots name columns.

A template is a JSON document with slots: ``{{ column }}`` or ``{{ column.field }}`` as a whole
value keeps the column's type, a slot inside a JSON string becomes part of the text; a text column
as a whole value has to hold JSON, which is copied as it is written. Slots take filters, with
literals as arguments. Comments ``{# ... #}`` are dropped.
The template is read once on the driver and becomes one ``to_json(named_struct(...))``.
"""

import ast
import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.functions.json_text import with_json_values
from tidegate.functions.missing import column, data_columns, without_nan
from tidegate.functions.patterns import python_text

_SLOT = re.compile(r"\{\{-?\s*(.*?)\s*-?\}\}", re.DOTALL)
_LITERAL = r"""(?:'[^']*'|"[^"]*"|[-\w.]+)"""
_FILTER = rf"\|\s*(\w+)\s*(?:\(\s*({_LITERAL}?(?:\s*,\s*{_LITERAL})*)\s*\))?\s*"
_SLOT_TEXT = re.compile(rf"(\w+(?:\.\w+)*)\s*((?:{_FILTER})*)")
# Slots are marked by characters from the private use area while the template is parsed.
_MARK = "\ue000{}\ue001"
_MARKED = re.compile("\ue000(\\d+)\ue001")
_WHOLE = "\ue002"
_SPLICED = "\ue003{}\ue004"
# A character that a JSON string cannot hold as it is.
_NEEDS_CARE = r'["\\\x00-\x1f]'

# Filters on the text of a slot.
TEXT_FILTERS: dict[str, Callable[..., Column]] = {
    "lower": F.lower,
    "upper": F.upper,
    "trim": F.trim,
    "string": lambda text: text,
    "replace": lambda text, old, new: F.replace(text, F.lit(str(old)), F.lit(str(new))),
}
# Filters that make a number of a slot; what is none becomes 0, rounding leaves it missing.
NUMBER_FILTERS: dict[str, tuple[T.DataType, Callable[..., Column]]] = {
    "round": (T.DoubleType(), lambda value, digits=0: F.round(value.try_cast("double"), digits)),
    "int": (T.LongType(), lambda value: F.coalesce(_truncated(value), F.lit(0).cast("bigint"))),
    "float": (T.DoubleType(), lambda value: F.coalesce(value.try_cast("double"), F.lit(0.0))),
}


def _truncated(value: Column) -> Column:
    return F.coalesce(value.try_cast("bigint"), value.try_cast("double").try_cast("bigint"))


@dataclass
class _Part:
    """A piece of the document: its Column, and a message for rows where it is not JSON."""

    value: Column
    error: Column | None = None


class _Template:
    def __init__(self, df: DataFrame, template: str):
        self.df = df
        self.slots: list[tuple[str, list]] = []
        # JSON texts that replace marks in the rendered text.
        self.spliced: list[tuple[str, Column]] = []
        # Texts to be parsed as JSON before rendering, by the name of the column they become.
        self.parsed: dict[str, Column] = {}
        text = re.sub(r"\{#.*?#\}", "", template, flags=re.DOTALL)
        if "{%" in text:
            raise ValueError("Template statements ({% ... %}) are not supported.")
        marked = _SLOT.sub(self._mark, text)
        # A mark outside of a string becomes a string of its own, so that the skeleton parses.
        pieces = re.split(r'("(?:[^"\\]|\\.)*")', marked)
        pieces[::2] = [_MARKED.sub(lambda m: f'"{_WHOLE}{m.group(1)}"', piece) for piece in pieces[::2]]
        try:
            self.skeleton = json.loads("".join(pieces))
        except json.JSONDecodeError as error:
            raise ValueError(f"The template is not a JSON document: {error}") from error

    def _mark(self, match: re.Match) -> str:
        found = _SLOT_TEXT.fullmatch(match.group(1))
        if not found:
            raise ValueError(f"Unsupported template expression: {match.group(0)}")
        name, filters = found.group(1), []
        for kind, arguments in re.findall(_FILTER, found.group(2)):
            values = ast.literal_eval(f"({arguments},)") if arguments else ()
            filters.append((kind, values))
        known = {*TEXT_FILTERS, *NUMBER_FILTERS, "default", "tojson"}
        if any(kind not in known for kind, _ in filters) or "tojson" in [k for k, _ in filters[:-1]]:
            raise ValueError(f"Unsupported template filters: {match.group(0)}")
        if name.split(".")[0] not in self.df.columns:
            raise KeyError(f"Column '{name.split('.')[0]}' of the template is not in the table.")
        self.slots.append((name, filters))
        return _MARK.format(len(self.slots) - 1)

    def _value(self, name: str) -> tuple[Column, T.DataType]:
        """A column, or a field of a struct column, NaN as missing."""
        first, *fields = name.split(".")
        if not fields:
            return without_nan(self.df, first), self.df.schema[first].dataType
        value = column(first)
        for field in fields:
            value = value.getField(field)
        dtype = self.df.select(value.alias("v")).schema["v"].dataType
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            value = F.when(~F.isnan(value), value)
        return value, dtype

    def _filtered(self, name: str, filters: list) -> tuple[Column, T.DataType]:
        """The value of a slot after its filters; text filters make text of it."""
        value, dtype = self._value(name)
        for kind, arguments in filters:
            if kind == "default":
                default = F.lit(arguments[0] if arguments else "")
                number = arguments and isinstance(arguments[0], (int, float))
                if not (number and isinstance(dtype, T.NumericType)) and not isinstance(dtype, T.StringType):
                    value = F.when(value.isNotNull(), python_text(value, dtype))
                    default, dtype = default.cast("string"), T.StringType()
                value = F.coalesce(value, default.cast(dtype))
            elif kind in NUMBER_FILTERS:
                dtype, function = NUMBER_FILTERS[kind]
                value = function(value, *arguments)
            elif kind in TEXT_FILTERS:
                text = F.coalesce(python_text(value, dtype), F.lit("None"))
                value, dtype = TEXT_FILTERS[kind](text, *arguments), T.StringType()
        return value, dtype

    def _text(self, name: str, filters: list) -> Column:
        """What the slot prints; a missing value prints as None."""
        if not filters and "." not in name:
            return F.coalesce(python_text(column(name), self.df.schema[name].dataType), F.lit("None"))
        return F.coalesce(python_text(*self._filtered(name, filters)), F.lit("None"))

    def whole(self, name: str, filters: list) -> _Part:
        """A slot that is a whole JSON value."""
        if filters and filters[-1][0] == "tojson":
            value = self._value(name)[0]
            if filters[:-1]:
                value, dtype = self._filtered(name, filters[:-1])
                if not isinstance(dtype, T.NumericType):
                    value = self._text(name, filters[:-1])
            return _Part(value)
        value, dtype = self._filtered(name, filters)
        missing = F.when(value.isNull(), F.lit(f"Slot '{name}' is missing."))
        if isinstance(dtype, T.NumericType):
            if isinstance(dtype, (T.DoubleType, T.FloatType)):
                endless = F.abs(value) == float("inf")
                missing = missing.when(endless, F.lit(f"Slot '{name}' is not a JSON number."))
            return _Part(value, missing)
        # Anything else prints as text, which has to be JSON and stays as it is written.
        text = F.when(value.isNotNull(), self._text(name, filters))
        parsed = self._parse(text)
        wrong = missing.when(parsed.isNull(), F.lit(f"Slot '{name}' is not valid JSON."))
        mark = _SPLICED.format(len(self.spliced))
        self.spliced.append((mark, text))
        return _Part(F.lit(mark), wrong)

    def _parse(self, text: Column) -> Column:
        name = f"_slot{len(self.parsed)}"
        self.parsed[name] = text
        return F.col(name)

    def string(self, text: str) -> _Part:
        """A JSON string with slots inside."""
        pieces, wrong = [], []
        for i, piece in enumerate(_MARKED.split(text)):
            if i % 2 == 0:
                if piece:
                    pieces.append(F.lit(piece))
                continue
            name, filters = self.slots[int(piece)]
            if any(kind == "tojson" for kind, _ in filters):
                raise ValueError(f"tojson cannot stand inside a string (slot '{name}').")
            shown = self._text(name, filters)
            # Text that is not plain is read as JSON reads it: escapes count, bare quotes fail.
            careful = shown.rlike(_NEEDS_CARE)
            parsed = self._parse(F.when(careful, F.concat(F.lit('"'), shown, F.lit('"'))))
            pieces.append(F.coalesce(F.try_variant_get(parsed, "$", "string"), shown))
            broken = parsed.isNull() & careful
            wrong.append(F.when(broken, F.lit(f"Slot '{name}' breaks the JSON string.")))
        return _Part(F.concat(*pieces), F.coalesce(*wrong))

    def build(self, node, errors: list[Column]) -> Column:
        if isinstance(node, dict):
            if any(_MARKED.search(key) for key in node):
                raise ValueError("Slots in JSON keys are not supported.")
            if not node:
                return F.parse_json(F.lit("{}"))
            return F.struct(*[self.build(v, errors).alias(k) for k, v in node.items()])
        if isinstance(node, list):
            return self._list(node, errors)
        if isinstance(node, str) and node.startswith(_WHOLE):
            part = self.whole(*self.slots[int(node[1:])])
        elif isinstance(node, str) and _MARKED.search(node):
            part = self.string(node)
        else:
            return F.lit(None).cast("string") if node is None else F.lit(node)
        if part.error is not None:
            errors.append(part.error)
        return part.value

    def _list(self, items: list, errors: list[Column]) -> Column:
        if not items:
            return F.array().cast("array<string>")
        built = [self.build(item, errors) for item in items]
        values = [F.parse_json(F.lit("null")).alias(name) for name in self.parsed]
        types = {f.dataType for f in self.df.select("*", *values).select(*built).schema.fields}
        if len(types) == 1:
            return F.array(*built)
        # Items of several types become VARIANT values.
        return F.array(*[self._variant(col) for col in built])

    def _variant(self, col: Column) -> Column:
        text = F.to_json(F.struct(col.alias("v")), {"ignoreNullFields": "false"})
        return F.try_variant_get(F.parse_json(text), "$.v", "variant")


def render_json(df: DataFrame, template: str, name: str = "json", keep: list[str] | None = None) -> DataFrame:
    """One compact JSON text per row, keys in template order; with ``keep``, after these columns.

    A row for which a slot gives no valid JSON becomes ``{"error": ..., "source_record": {...}}``.
    """
    compiled = _Template(df, template)
    errors: list[Column] = []
    options = {"ignoreNullFields": "false"}
    root = compiled.build(compiled.skeleton, errors)
    if isinstance(compiled.skeleton, (dict, list)):
        text = F.to_json(root, options)
    else:
        wrapped = F.to_json(F.struct(root.alias("v")), options)
        text = F.substring(wrapped, 6, F.length(wrapped) - 6)
    for mark, slot in compiled.spliced:
        text = F.replace(text, F.lit(f'"{mark}"'), F.trim(slot))
    record = F.struct(*[column(n).alias(n) for n in data_columns(df)])
    rows = with_json_values(df, compiled.parsed) if compiled.parsed else df
    if errors:
        error = F.col("_error")
        rows = rows.withColumn("_error", F.coalesce(*errors))
        envelope = F.to_json(F.struct(error.alias("error"), record.alias("source_record")), options)
        text = F.when(error.isNull(), text).otherwise(envelope)
    return rows.select(*[column(n) for n in keep or []], text.alias(name))


def is_error_record(text: Column) -> Column:
    """True for rendered rows that are error records."""
    return text.startswith('{"error":') & F.get_json_object(text, "$.source_record").isNotNull()
