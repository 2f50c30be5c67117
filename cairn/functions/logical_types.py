"""Logical type names to Spark types, and the checks that Spark's types don't make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Logical names without parameters. Unsigned types use the next wider signed one; 16-bit floats widen without loss.
PLAIN = {
    "null": T.NullType(), "bool": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(),
    "int64": T.LongType(), "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "halffloat": T.FloatType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "large_string": T.StringType(),
    "binary": T.BinaryType(), "large_binary": T.BinaryType(), "date32:day": T.DateType(), "date64:ms": T.DateType(),
}
#: Largest values of the unsigned types.
UNSIGNED = {"uint8": 2**8 - 1, "uint16": 2**16 - 1, "uint32": 2**32 - 1, "uint64": 2**64 - 1}
UNITS = ("s", "ms", "us", "ns")


def to_spark(name: str) -> T.DataType:
    """The Spark type of a logical type name; raises ValueError for one that has none.

    Times of day and nanosecond timestamps are whole numbers of their unit, so nothing is cut off.
    ``dict:V:I:ordered`` is its value type, and fixed sizes are checked by `checked`, not by the type.
    """
    if name in PLAIN:
        return PLAIN[name]
    kind, *rest = name.split(":")
    if kind == "timestamp" and rest and rest[0] in UNITS:
        zone = ":".join(rest[1:])
        return T.LongType() if rest[0] == "ns" else T.TimestampType() if zone not in ("", "-") else T.TimestampNTZType()
    if kind in ("time", "time32", "time64") and rest and rest[0] in UNITS:
        return T.LongType()
    if kind == "duration" and rest and rest[0] in UNITS:
        return T.LongType() if rest[0] == "ns" else T.DayTimeIntervalType()
    if kind == "decimal" and len(rest) == 3:
        bits, precision, scale = map(int, rest)
        if bits not in (128, 256) or not 0 < precision <= 38 or scale > precision:
            raise ValueError(f"{name}: Spark decimals have at most 38 digits")
        return T.DecimalType(precision, scale)
    if kind == "fixed_size_binary" and len(rest) == 1 and int(rest[0]) > 0:
        return T.BinaryType()
    if kind == "fixed_size_list" and len(rest) >= 2:
        return T.ArrayType(to_spark(":".join(rest[:-1])))
    if kind == "dict" and len(rest) >= 3:
        return to_spark(":".join(rest[:-2]))
    raise ValueError(f"{name}: no such logical type")


def to_logical(kind: T.DataType) -> str:
    """The logical name that `to_spark` reads back."""
    if isinstance(kind, T.DecimalType):
        return f"decimal:128:{kind.precision}:{kind.scale}"
    if isinstance(kind, T.TimestampType):
        return "timestamp:us:UTC"
    if isinstance(kind, T.TimestampNTZType):
        return "timestamp:us:-"
    if isinstance(kind, T.DayTimeIntervalType):
        return "duration:us"
    signed = {k: v for k, v in PLAIN.items() if k not in UNSIGNED and k != "halffloat"}
    for name, own in signed.items():
        if own == kind:
            return name
    raise ValueError(f"{kind.simpleString()}: no logical type")


def to_struct_type(fields: list[dict]) -> T.StructType:
    """A depth-first field list (``id``, ``parent_id``, ``name``, ``type``, ``nullable``) as a schema."""
    children: dict[int, list[dict]] = {}
    for f in fields:
        children.setdefault(f.get("parent_id", -1), []).append(f)

    def kind(f: dict) -> T.DataType:
        own = children.get(f["id"], [])
        if f["type"] == "struct":
            return T.StructType([field(c) for c in own])
        if f["type"] in ("list", "list.struct", "large_list", "large_list.struct"):
            if len(own) != 1:
                raise ValueError(f"{f['name']}: a list has one item field")
            return T.ArrayType(kind(own[0]), own[0].get("nullable", True))
        return to_spark(f["type"])

    field = lambda f: T.StructField(f["name"], kind(f), f.get("nullable", True))
    return T.StructType([field(f) for f in children.get(-1, [])])


def checked(column: Column, name: str) -> Column:
    """The column, failing at run time where a value isn't one of the logical type."""
    kind, *rest = name.split(":")
    ok = None
    if name in UNSIGNED:
        ok = (column >= 0) & (column.cast("decimal(20,0)") <= F.lit(str(UNSIGNED[name])).cast("decimal(20,0)"))
    elif kind == "fixed_size_binary":
        ok = F.octet_length(column) == int(rest[0])
    elif kind == "fixed_size_list":
        ok = F.size(column) == int(rest[-1])
    if ok is None:
        return column
    return F.when(column.isNull() | ok, column).otherwise(F.raise_error(F.lit(f"value is not {name}")))


def conform(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast and check columns by logical type name."""
    return df.withColumns({c: checked(F.col(c).cast(to_spark(t)), t) for c, t in types.items()})
