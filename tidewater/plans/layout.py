"""Target-table layout derived from a route.

Runs on the driver once per route; its output (a StructType, DDL text, table
properties, and per-column decode rules) is what executes at scale.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from tidewater.functions import pointer as jp
from tidewater.plans.avro import AvroType, parse_schema
from tidewater.settings import (COMMENT_PROPERTY, EPOCH_WATERMARK, FORMAT_VERSION_PROPERTY, POINTER_PROPERTY,
                                PUSH_EVENT_ID, TIMESTAMP_COLUMN, VARIANT_FORMAT_VERSION)


class LayoutError(ValueError):
    """The route cannot be turned into a target table."""


# The message texts a rejected layout reports (format placeholders in braces).
MESSAGES = {
    "not_record": "{what} must be an Avro record to derive iceberg columns from, got '{kind}'",
    "no_field": ("jsonExpressionPointer '{pointer}' does not resolve against the payloadSchema: "
                 "record '{record}' declares no field '{token}'"),
    "selected_field": "field '{token}' selected by jsonExpressionPointer",
    "unsupported_avro": "Unsupported avro type '{kind}' for payloadSchema field '{field}'",
    "duplicates": ("payloadSchema declares duplicate iceberg columns: {names}. "
                   "Rename the colliding fields, since iceberg resolves columns case-insensitively."),
    "unsupported_column": ("Unsupported iceberg column type '{type}' for column '{column}'. "
                           "Supported: string, int, long, double, float, boolean, binary, date, timestamp, variant."),
}


# The column type names a route may declare by hand, and their Spark types.
COLUMN_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "float": T.FloatType(),
    "boolean": T.BooleanType(),
    "binary": T.BinaryType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "variant": T.VariantType(),
}

# Avro type → column type name.
AVRO_COLUMN_TYPES = {
    "string": "string", "enum": "string", "int": "int", "long": "long", "float": "float",
    "double": "double", "boolean": "boolean", "bytes": "binary",
    "map": "variant", "array": "variant", "record": "variant",
}


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    source: str | None = None      # payload member the value is read from (None for envelope columns)
    union_tag: str | None = None   # branch name when the member is a tagged nullable union
    renamed: str | None = None     # the member's name where the gate has renamed it


def unwrap_nullable(t: AvroType) -> tuple[AvroType, str | None]:
    """["null", T] in any order → (T, tag); anything else unchanged."""
    if t.kind == "union":
        rest = [b for b in t.branches if b.kind != "null"]
        if len(rest) == 1:
            return rest[0], rest[0].branch_name
    return t, None


def _require_record(t: AvroType, what: str) -> AvroType:
    if t.kind != "record":
        raise LayoutError(MESSAGES["not_record"].format(what=what, kind=t.kind))
    return t


def resolve_payload_record(schema: AvroType, pointer: str | None) -> AvroType:
    record = _require_record(schema, "payloadSchema")
    for token in jp.segments(pointer):
        ftype = record.field(token)
        if ftype is None:
            raise LayoutError(MESSAGES["no_field"].format(pointer=pointer or "", record=record.fullname, token=token))
        record = _require_record(unwrap_nullable(ftype)[0], MESSAGES["selected_field"].format(token=token))
    return record


def derive_columns(schema_text: str, pointer: str | None = None) -> list[Column]:
    """One column per field of the selected record."""
    record = resolve_payload_record(parse_schema(schema_text), pointer)
    renamed = not jp.segments(pointer)
    cols = []
    for name, ftype in record.fields:
        inner, tag = unwrap_nullable(ftype)
        kind = AVRO_COLUMN_TYPES.get(inner.kind)
        if kind is None:
            raise LayoutError(MESSAGES["unsupported_avro"].format(kind=inner.kind, field=name))
        out_name = PUSH_EVENT_ID if (renamed and name == "id") else name
        cols.append(Column(out_name, kind, source=out_name if renamed else name, union_tag=tag))
    lowered: dict[str, int] = {}
    for c in cols:
        lowered[c.name.lower()] = lowered.get(c.name.lower(), 0) + 1
    dups = [n for n, k in lowered.items() if k > 1]
    if dups:
        raise LayoutError(MESSAGES["duplicates"].format(names=", ".join(dups)))
    return cols


def with_envelope_columns(cols: list[Column], merge_key: str) -> list[Column]:
    """Append timestampUTC and the merge key unless declared (case-insensitively)."""
    declared = {c.name.lower() for c in cols}
    extra = [Column(n, "string") for n in (TIMESTAMP_COLUMN, merge_key) if n.lower() not in declared]
    return list(cols) + extra


def resolve_columns(payload_schema: str | None, hand_columns: list[tuple[str, str]] | None,
                    pointer: str | None, merge_key: str) -> list[Column]:
    """Payload schema beats the hand-written list (D7), envelope appended."""
    if payload_schema is not None:
        base = derive_columns(payload_schema, pointer)
    else:
        # without a pointer the gate lands a document's own "id" under another name
        moved = jp.normalise(pointer) is None
        base = [Column(n, t, source=n, renamed=PUSH_EVENT_ID if moved and n == "id" else None) for n, t in (hand_columns or [])]
    return with_envelope_columns(base, merge_key)


def spark_type(type_name: str, column: str) -> T.DataType:
    """Column type name → Spark type, case-insensitive."""
    t = COLUMN_TYPES.get(type_name.lower())
    if t is None:
        raise LayoutError(MESSAGES["unsupported_column"].format(type=type_name.lower(), column=column))
    return t


def struct_type(cols: list[Column]) -> T.StructType:
    """All columns optional, in declaration order."""
    return T.StructType([T.StructField(c.name, spark_type(c.type, c.name), True) for c in cols])


def ddl(cols: list[Column]) -> str:
    return ", ".join(f"`{c.name.replace('`', '``')}` {spark_type(c.type, c.name).simpleString()}" for c in cols)


def creation_properties(cols: list[Column]) -> dict[str, str]:
    """A variant column needs format-version 3 at creation."""
    if any(c.type.lower() == "variant" for c in cols):
        return {FORMAT_VERSION_PROPERTY: VARIANT_FORMAT_VERSION}
    return {}


def initial_properties(declared: dict[str, str] | None, pointer: str | None) -> dict[str, str]:
    """Declared properties + epoch watermark comment when none + the pointer when non-blank."""
    props = dict(declared or {})
    props.setdefault(COMMENT_PROPERTY, EPOCH_WATERMARK)
    if pointer is not None and pointer.strip():
        props[POINTER_PROPERTY] = pointer
    return props
