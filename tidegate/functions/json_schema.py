"""JSON Schema (Draft 7) compiled to Column expressions over VARIANT values.

The schema is read once on the driver; what runs on the rows are built-in functions only. A reference
that leads back to a part that is being compiled is not compiled again: the value found there, its path
and the reference are left as work among the errors of the row. Work is done in rounds, each LEVELS levels of
recursion deeper, until no row has any; rows that are done leave the rounds.
"""

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.json_text import computed_once, json_literal, variant_entries, variant_items
from tidegate.functions.patterns import matches_anywhere
from tidegate.scratch import scratch_path

# Keywords that say nothing about validity ("format" is not checked by default).
ANNOTATIONS = {
    "$schema", "$id", "$comment", "title", "description", "default", "examples", "definitions",
    "readOnly", "writeOnly", "format", "contentEncoding", "contentMediaType",
}

# The type names of the standard.
TYPES = {"null", "boolean", "integer", "number", "string", "array", "object"}

_NO_ERRORS = "array<string>"

# Work among the errors: this mark, then the number of a reference, the value as JSON (which escapes
# the mark), and the path.
_WORK = "\0"

#: The rows are written once in so many levels of recursion.
LEVELS = 4


def _none() -> Column:
    return F.array().cast(_NO_ERRORS)


def _join(parts: list[Column]) -> Column:
    return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else _none()


class _Stages:
    """Columns that are computed before the checks, so that all checks share them.

    Stage *n* holds the values at depth *n* and what is known about the values at depth *n-1*.
    """

    def __init__(self):
        self.stages: list[dict[str, Column]] = []
        self.names: dict[tuple, str] = {}

    def add(self, stage: int, key: tuple, value: Column) -> Column:
        if key not in self.names:
            self.names[key] = f"_json{len(self.names)}"
            while len(self.stages) <= stage:
                self.stages.append({})
            self.stages[stage][self.names[key]] = value
        return F.col(self.names[key])

    def compute(self, df: DataFrame) -> DataFrame:
        for stage in self.stages:
            df = df.withColumns(stage) if stage else df
        return df


class _Spot:
    """A place in the document: its value and type, its printed path, its path for sorting.

    With ``stages``, what the checks need of the value is computed beforehand; values inside of
    arrays and of objects with unknown keys are computed in place.
    """

    def __init__(self, value: Column, path: Column, sort=(), stages=None, schema=None):
        self.value, self.path, self.sort, self.stages = value, path, sort, stages
        self._schema = F.schema_of_variant(value) if schema is None else schema

    def _known(self, what: str, value: Column) -> Column:
        if self.stages is None:
            return value
        return self.stages.add(len(self.sort) + 1, (*self.sort, what), value)

    @property
    def schema(self) -> Column:
        """Type of the value as Spark names it."""
        return self._known(".schema", self._schema)

    @property
    def number(self) -> Column:
        return self._known(".number", F.try_variant_get(self.value, "$", "double"))

    @property
    def entries(self) -> Column:
        return self._known(".entries", variant_entries(self.value))

    @property
    def items(self) -> Column:
        return self._known(".items", variant_items(self.value))

    def is_a(self, *kinds: str) -> Column:
        """Whether the value is of one of the JSON types; 1.0 is an integer."""
        schema = self.schema
        numeric = (schema == "BIGINT") | (schema == "DOUBLE") | schema.startswith("DECIMAL")
        tests = {
            "null": schema == "VOID",
            "boolean": schema == "BOOLEAN",
            "string": schema == "STRING",
            "array": schema.startswith("ARRAY"),
            "object": schema.startswith("OBJECT"),
            "number": numeric,
            "integer": (schema == "BIGINT") | (numeric & (self.number == F.floor(self.number))),
        }
        chosen = [tests[kind] for kind in kinds if kind != "integer" or "number" not in kinds]
        return reduce(Column.__or__, chosen)

    def child(self, name: str) -> "_Spot":
        if '"' in name or "\\" in name:
            value = F.element_at(variant_entries(self.value), name)
        else:
            value = F.try_variant_get(self.value, f'$["{name}"]', "variant")
        spot = self.at(value, F.lit(name), name)
        if self.stages is not None:
            spot.value = self.stages.add(len(spot.sort), (*spot.sort, ".value"), value)
            spot.stages, spot._schema = self.stages, F.schema_of_variant(spot.value)
        return spot

    def at(self, value: Column, step: Column, sort: str, schema: Column | None = None) -> "_Spot":
        path = F.concat(self.path, F.lit("/"), step) if self.sort else step
        return _Spot(value, path, (*self.sort, sort), schema=schema)

    def text(self) -> Column:
        """The value as it is printed in messages."""
        raw = F.to_json(self.value)
        return (
            F.when(self.schema == "STRING", F.concat(F.lit("'"), self.string(), F.lit("'")))
            .when(raw == "null", "None")
            .when(raw == "true", "True")
            .when(raw == "false", "False")
            .otherwise(raw)
        )

    def string(self) -> Column:
        return F.try_variant_get(self.value, "$", "string")

    def error(self, broken: Column, *message: Column | str) -> Column:
        parts = [F.lit(part) if isinstance(part, str) else part for part in message]
        text = F.concat(self.path, F.lit(": "), *parts)
        return F.when(broken, F.array(text)).otherwise(_none())


def _has_kind(spot: _Spot, names: list[str]) -> Column:
    unknown = set(names) - TYPES
    if unknown:
        raise ValueError(f"Unknown types in the schema: {sorted(unknown)}")
    return spot.is_a(*names)


def _compare(spot: _Spot, bound, test) -> Column:
    """Compare exactly where both sides are integers, else as doubles."""
    broken = test(spot.number, F.lit(float(bound)))
    if isinstance(bound, int) and abs(bound) < 2**63:
        exact = F.try_variant_get(spot.value, "$", "bigint")
        broken = F.when(spot.schema == "BIGINT", test(exact, F.lit(bound))).otherwise(broken)
    return spot.is_a("number") & broken


def _not_multiple(spot: _Spot, factor) -> Column:
    quotient = spot.number / F.lit(float(factor))
    broken = quotient != F.floor(quotient)
    if isinstance(factor, int):
        exact = F.try_variant_get(spot.value, "$", "bigint")
        broken = F.when(spot.schema == "BIGINT", exact % F.lit(factor) != 0).otherwise(broken)
    return spot.is_a("number") & broken


def _quoted_list(names: Column) -> Column:
    return F.array_join(F.transform(names, lambda n: F.concat(F.lit("'"), n, F.lit("'"))), ", ")


def _after(items: Column, start: int) -> Column:
    """The items from index ``start`` on."""
    return F.slice(items, start + 1, F.greatest(F.size(items) - start, F.lit(0))) if start else items


def _fields(value: Column) -> list[Column]:
    return [value.alias("value"), F.schema_of_variant(value).alias("schema")]


def _typed(value: Column, key: Column | None = None) -> Column:
    return F.struct(*_fields(value), *([] if key is None else [key.alias("key")]))


def _once(value: Column, use) -> Column:
    """What ``use`` makes of a value, which is computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


class _Compiler:
    def __init__(self, root: dict):
        self.root = root
        self.conditions = 0
        #: References that are left as work, by their numbers.
        self.recursive: list[str] = []

    def resolve(self, ref: str):
        if not ref.startswith("#"):
            raise ValueError(f"Only references within the schema are supported: {ref}")
        found = self.root
        for step in ref[1:].strip("/").split("/") if ref != "#" else []:
            step = step.replace("~1", "/").replace("~0", "~")
            found = found[int(step)] if isinstance(found, list) else found[step]
        return found

    def errors(self, schema, spot: _Spot, refs: tuple = ()) -> Column:
        """``array<string>`` of all violations, in the order of their paths."""
        found = sorted(self.checks(schema, spot, refs), key=lambda check: check[0])
        return _join([check for _, check in found])

    def valid(self, schema, spot: _Spot, refs: tuple) -> Column:
        self.conditions += 1
        try:
            return F.size(self.errors(schema, spot, refs)) == 0
        finally:
            self.conditions -= 1

    def reference(self, ref: str, spot: _Spot, refs: tuple) -> list[tuple[tuple, Column]]:
        """The checks of a reference; ``refs`` holds those that led here and how deep they were met."""
        depth = len(spot.sort)
        before = dict(refs)
        if ref not in before:
            return self.checks(self.resolve(ref), spot, (*refs, (ref, depth)))
        if before[ref] == depth:
            raise ValueError(f"The reference leads to itself: {ref}")
        if self.conditions:
            raise ValueError(
                "Recursive references are not supported within anyOf, oneOf, not, if and contains,"
                f" which have to know at once whether a value is valid: {ref}"
            )
        if ref not in self.recursive:
            self.recursive.append(ref)
        number = F.lit(f"{_WORK}{self.recursive.index(ref)}{_WORK}")
        work = F.concat(number, F.to_json(spot.value), F.lit(_WORK), spot.path)
        return [(spot.sort, F.when(spot.value.isNotNull(), F.array(work)).otherwise(_none()))]

    def worked(self, error: Column) -> Column:
        """What becomes of an error: itself, or the errors of the work that it stands for."""
        parts = F.split(error, _WORK, 4)
        work = F.struct(parts[1].alias("number"), F.parse_json(parts[2]).alias("value"), parts[3].alias("path"))

        def done(typed: Column) -> Column:
            spot = _Spot(typed["value"], typed["path"], ("~work",), schema=typed["schema"])
            found, at = F, 0
            while at < len(self.recursive):  # work may lead to further references
                ref = self.recursive[at]
                found = found.when(typed["number"] == str(at), self.errors(self.resolve(ref), spot, ((ref, 0),)))
                at += 1
            return found

        def typed(work: Column) -> Column:
            return F.struct(work["number"].alias("number"), work["path"].alias("path"), *_fields(work["value"]))

        return F.when(~error.startswith(_WORK), F.array(error)).otherwise(_once(work, lambda w: _once(typed(w), done)))

    def checks(self, schema, spot: _Spot, refs: tuple) -> list[tuple[tuple, Column]]:
        if schema is True or schema == {}:
            return []
        if schema is False:
            return [(spot.sort, spot.error(F.lit(True), "False schema does not allow ", spot.text()))]
        if "$ref" in schema:
            return self.reference(schema["$ref"], spot, refs)
        found = []
        for keyword, rule in schema.items():
            if keyword in ANNOTATIONS or keyword in ("then", "else", "additionalItems"):
                continue
            check = getattr(self, "kw_" + keyword, None)
            if check is None:
                raise ValueError(f"Unsupported JSON Schema keyword '{keyword}'.")
            made = check(rule, spot, schema, refs)
            found += made if isinstance(made, list) else [(spot.sort, made)]
        return found

    # One value.

    def kw_type(self, rule, spot, schema, refs):
        names = [rule] if isinstance(rule, str) else rule
        wanted = ", ".join(repr(name) for name in names)
        return spot.error(~_has_kind(spot, names), spot.text(), f" is not of type {wanted}")

    def kw_enum(self, rule, spot, schema, refs):
        allowed = [json_literal(json.dumps(item)) for item in rule]
        return spot.error(~F.to_json(spot.value).isin(*allowed), spot.text(), f" is not one of {rule!r}")

    def kw_const(self, rule, spot, schema, refs):
        return spot.error(F.to_json(spot.value) != json_literal(json.dumps(rule)), f"{rule!r} was expected")

    def kw_minimum(self, rule, spot, schema, refs):
        broken = _compare(spot, rule, lambda a, b: a < b)
        return spot.error(broken, spot.text(), f" is less than the minimum of {rule!r}")

    def kw_maximum(self, rule, spot, schema, refs):
        broken = _compare(spot, rule, lambda a, b: a > b)
        return spot.error(broken, spot.text(), f" is greater than the maximum of {rule!r}")

    def kw_exclusiveMinimum(self, rule, spot, schema, refs):
        broken = _compare(spot, rule, lambda a, b: a <= b)
        return spot.error(broken, spot.text(), f" is less than or equal to the minimum of {rule!r}")

    def kw_exclusiveMaximum(self, rule, spot, schema, refs):
        broken = _compare(spot, rule, lambda a, b: a >= b)
        return spot.error(broken, spot.text(), f" is greater than or equal to the maximum of {rule!r}")

    def kw_multipleOf(self, rule, spot, schema, refs):
        return spot.error(_not_multiple(spot, rule), spot.text(), f" is not a multiple of {rule!r}")

    def kw_minLength(self, rule, spot, schema, refs):
        broken = spot.is_a("string") & (F.length(spot.string()) < rule)
        return spot.error(broken, spot.text(), " should be non-empty" if rule == 1 else " is too short")

    def kw_maxLength(self, rule, spot, schema, refs):
        broken = spot.is_a("string") & (F.length(spot.string()) > rule)
        return spot.error(broken, spot.text(), " is expected to be empty" if rule == 0 else " is too long")

    def kw_pattern(self, rule, spot, schema, refs):
        broken = spot.is_a("string") & ~matches_anywhere(spot.string(), rule)
        return spot.error(broken, spot.text(), f" does not match {rule!r}")

    # Arrays.

    def kw_minItems(self, rule, spot, schema, refs):
        broken = F.size(spot.items) < rule
        return spot.error(
            spot.is_a("array") & broken, spot.text(),
            " should be non-empty" if rule == 1 else " is too short",
        )

    def kw_maxItems(self, rule, spot, schema, refs):
        broken = F.size(spot.items) > rule
        return spot.error(
            spot.is_a("array") & broken, spot.text(),
            " is expected to be empty" if rule == 0 else " is too long",
        )

    def kw_uniqueItems(self, rule, spot, schema, refs):
        if not rule:
            return []
        texts = F.transform(spot.items, lambda item: F.to_json(item))
        repeated = F.size(F.array_distinct(texts)) < F.size(texts)
        return spot.error(spot.is_a("array") & repeated, spot.text(), " has non-unique elements")

    def each_item(self, rule, spot, refs, start: int = 0):
        typed = F.transform(_after(spot.items, start), _typed)

        def errors(item, i):
            step = (i + start).cast("string")
            return self.errors(rule, spot.at(item["value"], step, "~items", item["schema"]), refs)

        found = F.flatten(F.transform(typed, errors))
        return ((*spot.sort, "~items"), F.when(spot.is_a("array"), found).otherwise(_none()))

    def kw_items(self, rule, spot, schema, refs):
        if not isinstance(rule, list):
            return [self.each_item(rule, spot, refs)] if rule is not True else []
        found, items = [], spot.items
        for i, item_rule in enumerate(rule):
            inner = spot.at(F.get(items, F.lit(i)), F.lit(str(i)), f"{i:09d}")
            found.append((inner.sort, self.present(item_rule, inner, refs)))
        more = schema.get("additionalItems", True)
        if more is False:
            extra = F.transform(_after(items, len(rule)), lambda item: F.to_json(item))
            were = F.when(F.size(extra) == 1, " was unexpected)").otherwise(" were unexpected)")
            found.append((spot.sort, spot.error(
                spot.is_a("array") & (F.size(items) > len(rule)),
                "Additional items are not allowed (", F.array_join(extra, ", "), were,
            )))
        elif more is not True:
            found.append(self.each_item(more, spot, refs, len(rule)))
        return found

    def kw_contains(self, rule, spot, schema, refs):
        items = spot.items
        some = F.exists(items, lambda item: self.valid(rule, spot.at(item, F.lit(""), "~item"), refs))
        return spot.error(
            spot.is_a("array") & ~some, "None of ", spot.text(), " are valid under the given schema"
        )

    # Objects.

    def present(self, rule, spot, refs) -> Column:
        """Errors of a value that may be absent."""
        return F.when(spot.value.isNotNull(), self.errors(rule, spot, refs)).otherwise(_none())

    def kw_properties(self, rule, spot, schema, refs):
        found = []
        for name, part in rule.items():
            inner = spot.child(name)
            if inner.stages is None:

                def checked(typed):  # is called at once
                    return self.present(part, spot.at(typed["value"], F.lit(name), name, typed["schema"]), refs)

                def referred(value):  # a value left as work needs no type here
                    return self.present(part, spot.at(value, F.lit(name), name), refs)

                reference = isinstance(part, dict) and "$ref" in part
                errors = _once(inner.value, referred if reference else lambda value: _once(_typed(value), checked))
            else:
                errors = self.present(part, inner, refs)
            found.append((inner.sort, F.when(spot.is_a("object"), errors).otherwise(_none())))
        return found

    def kw_required(self, rule, spot, schema, refs):
        return [
            (spot.sort, spot.error(
                spot.is_a("object") & spot.child(name).value.isNull(), f"{name!r} is a required property"
            ))
            for name in rule
        ]

    def kw_minProperties(self, rule, spot, schema, refs):
        broken = F.size(spot.entries) < rule
        text = " should be non-empty" if rule == 1 else " does not have enough properties"
        return spot.error(spot.is_a("object") & broken, spot.text(), text)

    def kw_maxProperties(self, rule, spot, schema, refs):
        broken = F.size(spot.entries) > rule
        text = " is expected to be empty" if rule == 0 else " has too many properties"
        return spot.error(spot.is_a("object") & broken, spot.text(), text)

    def each_entry(self, rule, spot, refs, wanted) -> tuple:
        entries = F.filter(F.map_entries(spot.entries), lambda e: wanted(e["key"]))
        typed = F.transform(entries, lambda e: _typed(e["value"], e["key"]))

        def errors(entry):
            inner = spot.at(entry["value"], entry["key"], "~entries", entry["schema"])
            return self.errors(rule, inner, refs)

        found = F.flatten(F.transform(typed, errors))
        return ((*spot.sort, "~entries"), F.when(spot.is_a("object"), found).otherwise(_none()))

    @staticmethod
    def _other_names(schema):
        known = list(schema.get("properties", {}))
        patterns = list(schema.get("patternProperties", {}))

        def other(key: Column) -> Column:
            free = ~key.isin(*known) if known else F.lit(True)
            for pattern in patterns:
                free = free & ~matches_anywhere(key, pattern)
            return free

        return other

    def kw_additionalProperties(self, rule, spot, schema, refs):
        if rule is True or rule == {}:
            return []
        other = self._other_names(schema)
        if rule is not False:
            return [self.each_entry(rule, spot, refs, other)]
        extra = F.filter(F.map_keys(spot.entries), other)
        were = F.when(F.size(extra) == 1, " was unexpected)").otherwise(" were unexpected)")
        return spot.error(
            spot.is_a("object") & (F.size(extra) > 0),
            "Additional properties are not allowed (", _quoted_list(extra), were,
        )

    def kw_patternProperties(self, rule, spot, schema, refs):
        return [
            self.each_entry(part, spot, refs, lambda key, p=pattern: matches_anywhere(key, p))
            for pattern, part in rule.items()
        ]

    def kw_propertyNames(self, rule, spot, schema, refs):
        names = F.map_keys(spot.entries)

        def errors(name):
            text = F.parse_json(F.concat(F.lit("["), F.to_json(F.array(name)), F.lit("]")))
            as_value = F.try_variant_get(text, "$[0][0]", "variant")
            return self.errors(rule, _Spot(as_value, spot.path, spot.sort), refs)

        found = F.flatten(F.transform(names, errors))
        return F.when(spot.is_a("object"), found).otherwise(_none())

    def kw_dependencies(self, rule, spot, schema, refs):
        found = []
        for name, needs in rule.items():
            given = spot.is_a("object") & spot.child(name).value.isNotNull()
            if isinstance(needs, list):
                for need in needs:
                    broken = given & spot.child(need).value.isNull()
                    found.append((spot.sort, spot.error(broken, f"{need!r} is a dependency of {name!r}")))
            else:
                found += self.guarded(given, needs, spot, refs)
        return found

    # Combinations.

    def guarded(self, condition, rule, spot, refs) -> list:
        return [
            (sort, F.when(condition, errors).otherwise(_none()))
            for sort, errors in self.checks(rule, spot, refs)
        ]

    def kw_allOf(self, rule, spot, schema, refs):
        return [check for part in rule for check in self.checks(part, spot, refs)]

    def _matching(self, rule, spot, refs) -> Column:
        counts = [self.valid(part, spot, refs).cast("int") for part in rule]
        return sum(counts[1:], counts[0])

    def kw_anyOf(self, rule, spot, schema, refs):
        broken = self._matching(rule, spot, refs) == 0
        return spot.error(broken, spot.text(), " is not valid under any of the given schemas")

    def kw_oneOf(self, rule, spot, schema, refs):
        matching = self._matching(rule, spot, refs)
        message = F.when(matching == 0, " is not valid under any of the given schemas").otherwise(
            " is valid under more than one of the given schemas"
        )
        return spot.error(matching != 1, spot.text(), message)

    def kw_not(self, rule, spot, schema, refs):
        return spot.error(
            self.valid(rule, spot, refs), spot.text(), f" should not be valid under {rule!r}"
        )

    def kw_if(self, rule, spot, schema, refs):
        holds = self.valid(rule, spot, refs)
        return self.guarded(holds, schema.get("then", True), spot, refs) + self.guarded(
            ~holds, schema.get("else", True), spot, refs
        )


def add_schema_errors(df: DataFrame, value: str, schema: dict | bool, name: str, unless: Column) -> DataFrame:
    """Add ``array<string>`` of ``path: message`` for each violation in a VARIANT column.

    ``unless`` gives the errors of rows that have no value to check, and NULL for the others. With a
    recursive schema the rows are written to the checkpoint folder, and again for every LEVELS levels
    of recursion that they have.
    """
    stages, compiler = _Stages(), _Compiler(schema)
    errors = compiler.errors(schema, _Spot(F.col(value), F.lit(""), stages=stages), (("#", 0),))
    checked = computed_once(stages.compute(df), name, F.coalesce(unless, errors))
    checked = checked.drop(*stages.names.values())
    return _without_work(checked.drop(value), name, compiler) if compiler.recursive else checked


def _without_work(df: DataFrame, name: str, compiler: _Compiler) -> DataFrame:
    """The rows when all work among their errors is done, round by round."""
    done, left = [], df
    has_work = F.exists(name, lambda error: error.startswith(_WORK))
    while True:
        for _ in range(LEVELS):
            left = left.withColumn(name, F.flatten(F.transform(name, compiler.worked)))
        path = scratch_path(df.sparkSession, "json-levels")
        left.write.parquet(path)
        level = df.sparkSession.read.schema(left.schema).parquet(path)
        done.append(level.filter(~has_work))
        left = level.filter(has_work)
        if left.isEmpty():
            return reduce(DataFrame.unionByName, done)
