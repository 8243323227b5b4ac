"""Compile a parsed Avro schema into one boolean Spark Column (gate F6).

The body is parsed once per row into a variant (``try_parse_json``); the compiled
predicate then walks it with ``try_variant_get`` / ``schema_of_variant`` /
``forall`` — all JVM-side expressions, so conformity checking stays inside
whole-stage codegen with no Python on the hot path.

Rules follow Avro's JSON decoding: record fields may come in any order, extra
fields are ignored, missing fields are rejected (defaults are not applied), union
values other than null are tagged with a one-key object naming the branch, and
integers must be integral and within range (see :func:`is_integral`).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.plans.avro import AvroType

_NUMERIC_KINDS = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT")


def variant_path(segments: list) -> str | None:
    """Render path segments (str keys / int indexes) as a variant path, None if not expressible."""
    out = "$"
    for s in segments:
        if isinstance(s, int):
            out += f"[{s}]"
        elif "'" not in s:
            out += f"['{s}']"
        elif '"' not in s:
            out += f'["{s}"]'
        else:
            return None
    return out


class _Node:
    """A variant value reached from ``base`` by ``path``; materialised lazily."""

    def __init__(self, base: Column, path: tuple = ()):
        self.base = base
        self.path = path

    def child(self, key) -> "_Node":
        rendered = variant_path(list(self.path) + [key])
        if rendered is None:          # key with both quote kinds: go through a map lookup
            as_map = self.col().try_cast("map<string,variant>")
            return _Node(F.try_element_at(as_map, F.lit(key)))
        return _Node(self.base, self.path + (key,))

    def col(self) -> Column:
        if not self.path:
            return self.base
        return F.try_variant_get(self.base, variant_path(list(self.path)), "variant")


def _kind(c: Column) -> Column:
    return F.schema_of_variant(c)


def _numeric(kind: Column) -> Column:
    return kind.isin(*_NUMERIC_KINDS) | kind.startswith("DECIMAL")


def _typed(node: _Node, sql_type: str) -> Column:
    """Typed value read straight from the base by path (no intermediate variant copy)."""
    rendered = variant_path(list(node.path)) if node.path else "$"
    if rendered is None:
        return F.try_variant_get(node.col(), "$", sql_type)
    return F.try_variant_get(node.base, rendered, sql_type)


def is_integral(kind: Column, read, bits: int) -> Column:
    """Whether a number is an Avro int (``bits`` 32) or long (64); ``read(type)`` gives its typed value.

    An integer must fit.  A number written with a fraction or an exponent counts when its nearest
    float (int) or double (long) is whole and in range, which is how Avro's JSON decoding reads it.
    Integers beyond 64 bits, and numbers like 7.0, are decimals without a fraction here: those must fit.
    """
    narrow, wide = ("int", "float") if bits == 32 else ("bigint", "double")
    whole = read(narrow).isNotNull()
    f = read(wide)
    floating = f.isNotNull() & (f == F.rint(f.cast("double"))) & (F.abs(f.cast("double")) <= float(2 ** (bits - 1)))
    return F.when(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | (kind.startswith("DECIMAL") & kind.endswith(",0)")), whole) \
        .when(_numeric(kind), floating).otherwise(F.lit(False))


def _check(t: AvroType, node: _Node, depth: int) -> Column:
    k = t.kind
    if k == "record":
        if not t.fields:
            return node.col().try_cast("map<string,variant>").isNotNull()
        # Every field check fails on a missing member, so "all fields pass" also proves "is an object".
        out = None
        for name, ftype in t.fields:
            c = _check(ftype, node.child(name), depth)
            out = c if out is None else (out & c)
        return out
    x = node.col()
    if k == "null":
        return F.is_variant_null(x)
    kind = _kind(x)
    if k == "boolean":
        return kind == "BOOLEAN"
    if k == "int":
        return is_integral(kind, lambda sql_type: _typed(node, sql_type), 32)
    if k == "long":
        return is_integral(kind, lambda sql_type: _typed(node, sql_type), 64)
    if k in ("float", "double"):
        return _numeric(kind)
    if k in ("string", "bytes"):
        return kind == "STRING"
    if k == "enum":
        return (kind == "STRING") & _typed(node, "string").isin(*t.symbols)
    if k == "fixed":
        return (kind == "STRING") & (F.length(_typed(node, "string")) == t.size)
    if k == "array":
        arr = x.try_cast("array<variant>")
        return arr.isNotNull() & F.forall(
            arr, lambda e: F.coalesce(_check(t.items, _Node(e), depth + 1), F.lit(False)))
    if k == "map":
        m = x.try_cast("map<string,variant>")
        return m.isNotNull() & F.forall(
            F.map_values(m), lambda e: F.coalesce(_check(t.values, _Node(e), depth + 1), F.lit(False)))
    if k == "union":
        m = x.try_cast("map<string,variant>")
        out = F.lit(False)
        for b in t.branches:
            if b.kind == "null":
                c = F.coalesce(F.is_variant_null(x), F.lit(False))
            else:
                c = (F.size(m) == 1) & _check(b, node.child(b.branch_name), depth)
            out = out | F.coalesce(c, F.lit(False))
        return out
    raise ValueError(f"unsupported Avro type {k}")


def conforms(t: AvroType, v: Column) -> Column:
    """Boolean Column: the parsed body ``v`` decodes under schema ``t`` with a record at the root."""
    root = _Node(v)
    if t.kind == "record":
        c = _check(t, root, 0)
    elif t.kind == "union":
        m = v.try_cast("map<string,variant>")
        c = F.lit(False)
        for b in t.branches:
            if b.kind == "record":
                c = c | F.coalesce((F.size(m) == 1) & _check(b, root.child(b.fullname), 0), F.lit(False))
    else:
        c = F.lit(False)          # a non-record root never yields a record
    return F.coalesce(v.isNotNull() & c, F.lit(False))
