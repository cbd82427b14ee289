"""One JSON text for equal values, however they are nested and in whatever order their fields and map entries come."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DecimalType, MapType, StructType

#: Fields that tell when something ran, not what it found.
RUNTIME = ("created_at", "captured_at", "decided_at", "occurred_at", "generated_at")


def canonical(value: Column, kind: DataType, leave_out: Sequence[str] = RUNTIME) -> Column:
    """The JSON text of a value of this type: fields and map keys in code-point order, nulls written, decimals without trailing zeros.

    Fields and map entries named in `leave_out` are left out at any depth. The text follows the type, so a map and a
    struct of the same entries read alike.
    """
    if isinstance(kind, StructType):
        fields = sorted((f for f in kind.fields if f.name not in leave_out), key=lambda f: f.name)
        parts = [F.concat(F.lit(f'{"," if i else ""}"{f.name}":'), canonical(value[f.name], f.dataType, leave_out)) for i, f in enumerate(fields)]
        text = F.concat(F.lit("{"), *parts, F.lit("}"))
    elif isinstance(kind, MapType):
        entries = F.filter(F.map_entries(value), lambda e: ~e["key"].cast("string").isin(*leave_out)) if leave_out else F.map_entries(value)
        said = F.array_sort(F.transform(entries, lambda e: F.struct(e["key"].cast("string").alias("k"), F.concat(_plain(e["key"].cast("string")), F.lit(":"), canonical(e["value"], kind.valueType, leave_out)).alias("s"))))
        text = F.concat(F.lit("{"), F.array_join(F.transform(said, lambda e: e["s"]), ","), F.lit("}"))
    elif isinstance(kind, ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical(x, kind.elementType, leave_out)), ","), F.lit("]"))
    elif isinstance(kind, DecimalType):
        text = F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "") if kind.scale else value.cast("string")
    else:
        text = _plain(value)
    return F.when(value.isNull(), F.lit("null")).otherwise(text)


def _plain(value: Column) -> Column:
    """The JSON text of a string, number, boolean, date or time."""
    text = F.to_json(F.array(value), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
    return F.substring(text, F.lit(2), F.length(text) - 2)


def canonical_row(df: DataFrame, columns: Sequence[str] | None = None, leave_out: Sequence[str] = RUNTIME) -> Column:
    """The canonical JSON text of each row's columns (all of them by default)."""
    names = list(columns or df.columns)
    kind = StructType([df.schema[n] for n in names])
    return canonical(F.struct(*names), kind, leave_out)
