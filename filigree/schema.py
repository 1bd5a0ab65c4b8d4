"""Attribute layouts.

Typed (``STRUCT``): a column each, pruned and pushed down to Parquet; a key is
present where its value is not null.  Dynamic (``MAP<STRING, VALUE>``): a
tagged union that keeps presence apart from null and integers from floats.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VALUE = T.StructType(
    [
        T.StructField("t", T.StringType()),  # String Int Float Half Bool None List Dict
        T.StructField("s", T.StringType()),
        T.StructField("i", T.LongType()),
        T.StructField("d", T.DoubleType()),
        T.StructField("b", T.BooleanType()),
        T.StructField("j", T.StringType()),  # canonical JSON of lists and dicts
    ]
)
ATTR = T.MapType(T.StringType(), VALUE)
NODES = T.StructType([T.StructField("id", T.StringType()), T.StructField("attr", ATTR), T.StructField("meta", ATTR)])
EDGES = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "src", "dst")] + [T.StructField("attr", ATTR), T.StructField("meta", ATTR), T.StructField("seq", T.LongType())])


def canonical(value: Any) -> str:
    """JSON in which equal values have equal text: 1, 1.0 and true are one number."""

    def plain(v: Any) -> Any:
        if isinstance(v, bool):
            return int(v)
        if isinstance(v, float) and v.is_integer() and abs(v) < 1 << 53:
            return int(v)
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        return v

    return json.dumps(plain(value), sort_keys=True, ensure_ascii=False)


def encode(value: Any) -> tuple:
    """A Python value as a VALUE row; unknown types become their text, integers beyond 64 bits floats."""
    none = (None, None, None, None, None)
    if value is None:
        return ("None", *none)
    if isinstance(value, bool):
        return ("Bool", None, None, None, value, None)
    if isinstance(value, str):
        return ("String", value, None, None, None, None)
    if isinstance(value, int):
        return ("Int", None, value, None, None, None) if -(1 << 63) <= value < 1 << 63 else ("Float", None, None, float(value), None, None)
    if isinstance(value, float):
        return ("Float", None, None, value, None, None)
    if isinstance(value, (list, tuple)):
        return ("List", None, None, None, None, json.dumps([*value], default=str, ensure_ascii=False))
    if isinstance(value, dict):
        return ("Dict", None, None, None, None, json.dumps(value, default=str, ensure_ascii=False))
    return ("String", str(value), None, None, None, None)


def encode_map(values: dict[str, Any] | None) -> dict[str, tuple]:
    return {str(k): encode(v) for k, v in (values or {}).items()}


def decode(row: Any) -> Any:
    if row is None or row["t"] == "None":
        return None
    kind = row["t"]
    if kind == "String":
        return row["s"]
    if kind == "Int":
        return row["i"]
    if kind in ("Float", "Half"):
        return row["d"]
    if kind == "Bool":
        return row["b"]
    return json.loads(row["j"])


def decode_attr(attr: Any) -> dict[str, Any]:
    """Attributes of either layout as a Python dict; of typed ones the keys that are present."""
    if attr is None:
        return {}
    if isinstance(attr, dict):
        return {k: decode(v) for k, v in attr.items()}
    return {k: v for k, v in attr.asDict(recursive=True).items() if v is not None}


class Attributes:
    """Access to attributes of either layout as columns."""

    def __init__(self, schema: T.StructType, column: str = "attr"):
        self.kind = schema[column].dataType
        self.column = column
        self.dynamic = isinstance(self.kind, T.MapType)

    def has(self, key: str) -> Column:
        if self.dynamic:
            return F.coalesce(F.map_contains_key(F.col(self.column), key), F.lit(False))
        return F.col(f"{self.column}.`{key}`").isNotNull() if key in self.kind.names else F.lit(False)

    def get(self, key: str) -> Column:
        if self.dynamic:
            return F.try_element_at(F.col(self.column), F.lit(key))
        return F.col(f"{self.column}.`{key}`") if key in self.kind.names else F.lit(None)

    def type_of(self, key: str) -> T.DataType | None:
        """Of a typed attribute; None for unknown keys."""
        return self.kind[key].dataType if not self.dynamic and key in self.kind.names else None

    def equals(self, key: str, value: Any) -> Column:
        """Python's ``==`` with a value, never null; an absent key equals only None."""
        at = self.get(key)
        if value is None:
            return (at.isNull() | (at["t"] == "None")) if self.dynamic else at.isNull()
        if not self.dynamic:
            kind = self.type_of(key)
            if kind is None:
                return F.lit(False)
            text = isinstance(kind, T.StringType)
            if isinstance(value, (list, tuple)):
                return at.eqNullSafe(F.lit([*value])) if isinstance(kind, T.ArrayType) else F.lit(False)
            if text != isinstance(value, str) or isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
                return F.lit(False)  # strings never equal numbers
            if isinstance(kind, T.BooleanType) or isinstance(value, bool):
                return at.cast("double").eqNullSafe(F.lit(float(value)))
            return at.eqNullSafe(F.lit(value))
        if isinstance(value, str):
            return F.coalesce((at["t"] == "String") & (at["s"] == value), F.lit(False))
        if isinstance(value, (bool, int, float)):
            return F.coalesce(number(at) == F.lit(float(value)), F.lit(False)) if not isinstance(value, int) or isinstance(value, bool) or abs(value) < 1 << 53 else F.coalesce(at["i"] == value, F.lit(False))
        same = F.udf(lambda j: j is not None and canonical(json.loads(j)) == wanted, T.BooleanType())
        wanted = canonical(value)
        return F.coalesce(same(at["j"]), F.lit(False))

    def text(self, key: str) -> Column:
        """The value if it is a string, else null."""
        at = self.get(key)
        if self.dynamic:
            return F.when(at["t"] == "String", at["s"])
        return at if isinstance(self.type_of(key), T.StringType) else F.lit(None).cast("string")


def number(value: Column) -> Column:
    """The number that a dynamic value is, else null."""
    return F.coalesce(value["d"], value["i"].cast("double"), value["b"].cast("double"))
