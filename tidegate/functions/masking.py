"""Masking of sensitive fields, judged by their names, at any depth of a table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.functions.missing import column

# The replacement, and the name parts that mark a field as sensitive.
MASK = "***REDACTED***"
SENSITIVE = (
    "password", "passwd", "secret", "token", "api_key", "apikey", "authorization",
    "credential", "private_key",
)


def is_sensitive(name: str) -> bool:
    plain = name.lower().replace("-", "_")
    return any(part in plain for part in SENSITIVE)


def _holds_sensitive(dtype: T.DataType) -> bool:
    """Whether a value of this type can have anything to mask inside."""
    if isinstance(dtype, T.StructType):
        return any(is_sensitive(f.name) or _holds_sensitive(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _holds_sensitive(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return isinstance(dtype.keyType, T.StringType) or _holds_sensitive(dtype.valueType)
    return False


def _masked_field(value: Column, field: T.StructField) -> Column:
    return F.lit(MASK) if is_sensitive(field.name) else _masked(value, field.dataType)


def _masked(value: Column, dtype: T.DataType) -> Column:
    if not _holds_sensitive(dtype):
        return value
    if isinstance(dtype, T.StructType):
        fields = [_masked_field(value.getField(f.name), f).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda item: _masked(item, dtype.elementType))

    def masked_entry(key: Column, item: Column) -> Column:
        if not isinstance(dtype.keyType, T.StringType):
            return _masked(item, dtype.valueType)
        named = F.replace(F.lower(key), F.lit("-"), F.lit("_")).rlike("|".join(SENSITIVE))
        inner = _masked(item, dtype.valueType)
        if isinstance(dtype.valueType, T.StringType):
            return F.when(named, F.lit(MASK)).otherwise(inner)
        # The mask is text, so all values of such a map become text.
        if isinstance(dtype.valueType, (T.StructType, T.ArrayType, T.MapType)):
            inner = F.to_json(inner, {"ignoreNullFields": "false"})
        return F.when(named, F.lit(MASK)).otherwise(inner.cast("string"))

    return F.transform_values(value, masked_entry)


def mask_sensitive(df: DataFrame) -> DataFrame:
    """Replace every field whose name looks sensitive by a fixed text, also in nested values.

    A masked field becomes text. Maps with text keys are masked by key; their other values
    become text too unless they are text already.
    """
    return df.select(*[_masked_field(column(f.name), f).alias(f.name) for f in df.schema.fields])
