"""Values of any shape as bytes that sort and as text that is equal when they are.

``sort_key`` encodes a value so that comparing the bytes compares the values in the
total order: missing < null < bigint < number < NaN < boolean < string < bytes < array <
object. Arrays compare element by element, the shorter first; objects as their (key,
value) pairs by key; strings by UTF-8 bytes; the two zeros are one number. Keys of
several values may be joined: each ends by itself, so the joined bytes compare like a
tuple, and a prefix of values is a range of bytes.

``canonical`` is the JSON form of values: keys sorted, 64-bit integers, bytes and the
numbers that JSON lacks tagged by their type. Two values are structurally equal (order of
keys aside, NaN equal to itself, the zeros told apart) when their text is.

SQL NULL is the missing value at the top and null inside arrays, objects and maps, as
Spark has no field that is absent from a row. Typed columns are encoded by JVM functions
along their schema; a VARIANT, whose shape only its rows know, takes a small recursive
function over Arrow batches.
"""

from __future__ import annotations

import base64
import json
import math
import re
import struct
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# First bytes of the kinds in the total order; END closes strings, arrays and objects.
END, MISSING, NULL, BIGINT, NUMBER, NAN, BOOLEAN, STRING, BYTES, ARRAY, OBJECT = (bytes([k]) for k in range(11))
#: Above every byte that can follow a whole key.
BEYOND = b"\xff"

_SIGN = -(1 << 63)


def _escaped(data: bytes) -> bytes:
    """Without the byte 0, in the same order, and closed by it."""
    return data.replace(b"\x01", b"\x01\x02").replace(b"\x00", b"\x01\x01") + END


def key_bytes(value: object) -> bytes:
    """``sort_key`` of a Python value; None is null."""
    if value is None:
        return NULL
    if isinstance(value, bool):
        return BOOLEAN + bytes([value])
    if isinstance(value, int):
        return BIGINT + (value - _SIGN).to_bytes(8, "big")
    if isinstance(value, (float, Decimal)):
        x = float(value) + 0.0
        if math.isnan(x):
            return NAN
        (bits,) = struct.unpack(">Q", struct.pack(">d", x))
        return NUMBER + (bits ^ (2**64 - 1 if bits >> 63 else 1 << 63)).to_bytes(8, "big")
    if isinstance(value, str):
        return STRING + _escaped(value.encode())
    if isinstance(value, (bytes, bytearray)):
        return BYTES + _escaped(bytes(value))
    if isinstance(value, (list, tuple)):
        return ARRAY + b"".join(map(key_bytes, value)) + END
    if isinstance(value, dict):
        return OBJECT + b"".join(key_bytes(k) + key_bytes(value[k]) for k in sorted(value, key=str.encode)) + END
    raise TypeError(f"no place in the order of values for {type(value).__name__}")


@F.pandas_udf(T.BinaryType())
def _variant_key(values: pd.Series) -> pd.Series:
    return values.map(lambda v: MISSING if v is None else key_bytes(v.toPython()))


def _hex(data: bytes) -> Column:
    return F.lit(data.hex().upper())


def _long_hex(x: Column) -> Column:
    return F.lpad(F.hex(x.bitwiseXOR(F.lit(_SIGN))), 16, "0")


def _double_hex(x: Column) -> Column:
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), x + F.lit(0.0)).cast("long")
    return F.lpad(F.hex(F.when(bits < 0, F.bitwise_not(bits)).otherwise(bits.bitwiseXOR(F.lit(_SIGN)))), 16, "0")


def _text_hex(x: Column, charset: str) -> Column:
    whole = F.replace(F.replace(x, F.lit("\x01"), F.lit("\x01\x02")), F.lit("\x00"), F.lit("\x01\x01"))
    return F.concat(F.hex(F.encode(whole, charset)), _hex(END))


def _typed(x: Column, kind: T.DataType) -> Column:
    """Hex digits of a typed value's key; null inside."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        out = F.concat(_hex(BIGINT), _long_hex(x.cast("long")))
    elif isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        d = x.cast("double")
        out = F.when(F.isnan(d), _hex(NAN)).otherwise(F.concat(_hex(NUMBER), _double_hex(d)))
    elif isinstance(kind, T.BooleanType):
        out = F.concat(_hex(BOOLEAN), F.when(x, "01").otherwise("00"))
    elif isinstance(kind, T.StringType):
        out = F.concat(_hex(STRING), _text_hex(x, "UTF-8"))
    elif isinstance(kind, T.BinaryType):
        out = F.concat(_hex(BYTES), _text_hex(F.decode(x, "ISO-8859-1"), "ISO-8859-1"))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(_hex(ARRAY), F.array_join(F.transform(x, lambda e: _typed(e, kind.elementType)), ""), _hex(END))
    elif isinstance(kind, T.MapType):
        pairs = F.transform(F.array_sort(F.map_keys(x)), lambda k: F.concat(_typed(k, kind.keyType), _typed(F.element_at(x, k), kind.valueType)))
        out = F.concat(_hex(OBJECT), F.array_join(pairs, ""), _hex(END))
    elif isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name.encode())
        out = F.concat(_hex(OBJECT), *[c for f in fields for c in (_hex(key_bytes(f.name)), _typed(x[f.name], f.dataType))], _hex(END))
    elif isinstance(kind, T.NullType):
        return _hex(NULL)
    else:
        raise TypeError(f"no place in the order of values for {kind.simpleString()}")
    return F.when(x.isNull(), _hex(NULL)).otherwise(out)


def has_variant(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(has_variant(f.dataType) for f in kind.fields)
    if isinstance(kind, T.MapType):
        return has_variant(kind.valueType)
    return has_variant(kind.elementType) if isinstance(kind, T.ArrayType) else isinstance(kind, T.VariantType)


def as_variant(x: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.VariantType):
        return x
    return F.to_variant_object(x) if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)) else x.cast("variant")


def sort_key(x: Column, kind: T.DataType) -> Column:
    """The value as bytes in the total order; SQL NULL is the missing value."""
    if has_variant(kind):
        return _variant_key(as_variant(x, kind))
    return F.when(x.isNull(), F.lit(MISSING)).otherwise(F.unhex(_typed(x, kind)))


# The JSON form


def js_number(x: float) -> str:
    """A finite number as JSON text has it: the fewest digits, an exponent from 1e21 up and below 1e-6."""
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    mantissa, _, power = repr(x).partition("e")
    if not power:
        whole, _, part = mantissa.partition(".")
        return mantissa if part != "0" else whole
    digits, at = mantissa.replace(".", "").lstrip("-"), int(power)
    sign = "-" if x < 0 else ""
    if -7 < at < 0:
        return f"{sign}0.{'0' * (-at - 1)}{digits}"
    return f"{sign}{digits[0]}{'.' + digits[1:] if digits[1:].strip('0') else ''}e{at:+d}"


def _tagged(tag: str, data: bytes) -> str:
    return f'{{"{tag}":"{base64.b64encode(data).decode()}"}}'


def canonical_text(value: object) -> str:
    """``canonical`` of a Python value."""
    if value is None or isinstance(value, (bool, str)):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, int):
        return _tagged("$integer", struct.pack("<q", value))
    if isinstance(value, (float, Decimal)):
        x = float(value)
        special = math.isnan(x) or math.isinf(x) or (x == 0 and math.copysign(1, x) < 0)
        return _tagged("$float", struct.pack("<d", x)) if special else js_number(x)
    if isinstance(value, (bytes, bytearray)):
        return _tagged("$bytes", bytes(value))
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical_text, value)) + "]"
    if isinstance(value, dict):
        if bad := [k for k in value if k.startswith("$")]:
            raise ValueError(f"field names may not begin with $: {bad[0]}")
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical_text(value[k])}" for k in sorted(value, key=str.encode)) + "}"
    raise TypeError(f"no JSON form for {type(value).__name__}")


def parsed(text: str) -> object:
    """The value of a JSON form; bare numbers are floating-point."""

    def tags(pairs: list[tuple[str, object]]) -> object:
        if len(pairs) == 1 and pairs[0][0].startswith("$"):
            tag, data = pairs[0][0], base64.b64decode(str(pairs[0][1]))
            if tag == "$bytes":
                return data
            if tag in ("$integer", "$float") and len(data) == 8:
                return struct.unpack("<q" if tag == "$integer" else "<d", data)[0]
            raise ValueError(f"unknown or malformed tag {tag}")
        if bad := [k for k, _ in pairs if k.startswith("$")]:
            raise ValueError(f"field names may not begin with $: {bad[0]}")
        return dict(pairs)

    return json.loads(text, object_pairs_hook=tags, parse_int=float)


@F.pandas_udf(T.StringType())
def _variant_text(values: pd.Series) -> pd.Series:
    return values.map(lambda v: '{"$undefined":true}' if v is None else canonical_text(v.toPython()))


def canonical(x: Column, kind: T.DataType) -> Column:
    """The value's JSON form; SQL NULL has a form of its own."""
    return _variant_text(as_variant(x, kind))


#: Shapes of which JSON text tells all once the shapes are the same; the others, such as lists of mixed kinds, decimals and keys with signs, need ``canonical``.
_TOLD = r"^(OBJECT|ARRAY|BIGINT|DOUBLE|STRING|BOOLEAN|VOID|BINARY|[A-Za-z_][A-Za-z0-9_]*: |[<>]|, )*$"


@F.pandas_udf(T.BooleanType())
def _same_text(a: pd.Series, b: pd.Series, asked: pd.Series) -> pd.Series:
    text = lambda v: None if v is None else canonical_text(v.toPython())
    return pd.Series([text(x) == text(y) if q else None for x, y, q in zip(a, b, asked, strict=True)], dtype=object) if asked.any() else pd.Series([None] * len(asked), dtype=object)


def structurally_equal(a: Column, a_kind: T.DataType, b: Column, b_kind: T.DataType) -> Column:
    """Whether two values of any shapes are equal; never null. Values of plain shapes are compared in the JVM, only others go to Python."""
    x, y = as_variant(a, a_kind), as_variant(b, b_kind)
    shapes = F.schema_of_variant(x), F.schema_of_variant(y)
    told = F.coalesce(shapes[0].rlike(_TOLD), F.lit(True)) & F.coalesce(shapes[1].rlike(_TOLD), F.lit(True))
    same = shapes[0].eqNullSafe(shapes[1]) & F.to_json(x).eqNullSafe(F.to_json(y))
    if not (_may_hide(a_kind) or _may_hide(b_kind)):
        return same
    left = F.when(~told, x), F.when(~told, y)
    return F.when(told, same).otherwise(_same_text(*left, ~told))


def _may_hide(kind: T.DataType) -> bool:
    """Whether values of a type may have a shape that is not told by text."""
    if isinstance(kind, T.StructType):
        return any(_may_hide(f.dataType) or re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", f.name) is None for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _may_hide(kind.elementType)
    return not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DoubleType, T.StringType, T.BooleanType, T.BinaryType, T.NullType))


def from_canonical(text: Column, kind: T.DataType) -> Column:
    """The typed value of a JSON form; fields that the type lacks are left out, null stays null."""

    def read(value: str | None) -> object:
        return None if value is None else fitted(parsed(value), kind)

    return F.udf(read, kind, useArrow=True)(text)


def fitted(value: object, kind: T.DataType) -> object:
    """A parsed value for a Spark type."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: fitted(value.get(f.name), f.dataType) for f in kind.fields}
    if isinstance(kind, T.MapType):
        return {k: fitted(x, kind.valueType) for k, x in value.items()}
    if isinstance(kind, T.ArrayType):
        return [fitted(x, kind.elementType) for x in value]
    return value
