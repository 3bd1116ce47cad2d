"""NGSI entities: the rules of NGSI-LD and NGSI-v2 on one JSON entity."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Attribute types of NGSI-LD, and the keys that are not attributes.
LD_TYPES = ("Property", "Relationship", "GeoProperty")
RESERVED = {"ld": ("id", "type", "@context"), "v2": ("id", "type")}


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(part) if isinstance(part, str) else part for part in parts])


def _member(value: Column, name: str) -> Column:
    """A member of a VARIANT object: NULL if it is absent, VARIANT null if it is null."""
    return F.try_variant_get(value, f"$.{name}", "variant")


def _ld_errors(name: Column, value: Column) -> Column:
    kind = _member(value, "type")
    text = F.try_variant_get(kind, "$", "string")
    known = text.isin(*LD_TYPES) & (F.schema_of_variant(kind) == "STRING")
    relationship = F.coalesce(text == "Relationship", F.lit(False))
    return F.array(
        F.when(~F.coalesce(known, F.lit(False)),
               _text("NGSI-LD attribute '", name, "' has invalid 'type'.")),
        F.when(relationship & _member(value, "object").isNull(),
               _text("NGSI-LD attribute '", name, "' missing 'object'.")),
        F.when(~relationship & _member(value, "value").isNull(),
               _text("NGSI-LD attribute '", name, "' missing 'value'.")),
    )


def _v2_errors(name: Column, value: Column) -> Column:
    return F.array(
        *[
            F.when(_member(value, key).isNull(),
                   _text("NGSI-v2 attribute '", name, f"' missing '{key}'."))
            for key in ("type", "value")
        ]
    )


def entity_errors(entries: Column, version: str = "ld") -> Column:
    """``array<string>`` of what is wrong with an entity, given as ``map<string, variant>``."""
    version = version.lower()
    if version not in RESERVED:
        raise ValueError(f"ngsi_version must be 'ld' or 'v2', not '{version}'.")
    rules = _ld_errors if version == "ld" else _v2_errors

    def attribute_errors(entry: Column) -> Column:
        name, value = entry["key"], entry["value"]
        not_object = F.array(_text("Attribute '", name, "' must be a dictionary."))
        is_object = F.schema_of_variant(value).startswith("OBJECT")
        errors = F.when(is_object, rules(name, value)).otherwise(not_object)
        return F.when(~name.isin(*RESERVED[version]), errors).otherwise(F.array(F.lit(None).cast("string")))

    missing = [
        F.when(~F.map_contains_key(entries, key), F.lit(f"Missing '{key}'.")) for key in ("id", "type")
    ]
    attributes = F.flatten(F.transform(F.map_entries(entries), attribute_errors))
    return F.array_compact(F.concat(F.array(*missing), attributes))
