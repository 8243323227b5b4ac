"""Avro schema reading on the driver.

A route's ``payloadSchema`` is parsed once per route (never per row).  The parsed
tree feeds three consumers:

* the parsing canonical form and its CRC-64-AVRO fingerprint (schema identity),
* the conformity predicate compiler (``tidewater.plans.predicate``), which turns
  the tree into one Spark Column evaluated inside whole-stage codegen,
* the target-table layout derivation (``tidewater.plans.layout``).

Only what those need is modelled: named types with namespaces, records, enums,
fixed, arrays, maps, unions and the primitives.  Logical types are ignored.
"""

from __future__ import annotations

import json
import re
import struct
from dataclasses import dataclass, field

# Fixed values from the Avro specification.
PRIMITIVES = ("null", "boolean", "int", "long", "float", "double", "bytes", "string")
_NAME_RE = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")
CRC64_EMPTY = 0xC15D213AA4D7A795


class AvroSchemaError(ValueError):
    """The schema text is not a valid Avro schema."""


@dataclass(eq=False)
class AvroType:
    kind: str                                   # primitive name or record/enum/fixed/array/map/union
    fullname: str | None = None                 # named types only
    fields: list = field(default_factory=list)  # records: [(name, AvroType)]
    symbols: list = field(default_factory=list) # enums
    size: int | None = None                     # fixed
    items: "AvroType | None" = None             # arrays
    values: "AvroType | None" = None            # maps
    branches: list = field(default_factory=list)  # unions

    @property
    def is_named(self) -> bool:
        return self.kind in ("record", "enum", "fixed")

    @property
    def branch_name(self) -> str:
        """Key naming this type as a union branch in Avro's JSON encoding."""
        return self.fullname if self.is_named else self.kind

    def field(self, name: str) -> "AvroType | None":
        for fname, ftype in self.fields:
            if fname == name:
                return ftype
        return None


def _fullname(name: str, namespace: str | None) -> tuple[str, str | None]:
    if "." in name:
        space, _, short = name.rpartition(".")
        parts = name.split(".")
    else:
        space, short = namespace, name
        parts = [name]
    for p in parts:
        if not _NAME_RE.match(p):
            raise AvroSchemaError(f"Illegal name: {name}")
    full = f"{space}.{short}" if space else short
    return full, (space or None)


class _Parser:
    def __init__(self) -> None:
        self.names: dict[str, AvroType] = {}
        self.defaults: dict[str, dict] = {}          # record → field → default, for nested defaults

    def lookup(self, name: str, namespace: str | None) -> AvroType:
        if name in PRIMITIVES:
            return AvroType(name)
        candidates = [name] if "." in name else ([f"{namespace}.{name}"] if namespace else []) + [name]
        for c in candidates:
            if c in self.names:
                return self.names[c]
        raise AvroSchemaError(f'"{name}" is not a defined name.')

    def define(self, t: AvroType) -> None:
        if t.fullname in self.names:
            raise AvroSchemaError(f"Can't redefine: {t.fullname}")
        self.names[t.fullname] = t

    def parse(self, node, namespace: str | None) -> AvroType:
        if isinstance(node, str):
            return self.lookup(node, namespace)
        if isinstance(node, list):
            branches = [self.parse(b, namespace) for b in node]
            seen = set()
            for b in branches:
                if b.kind == "union":
                    raise AvroSchemaError("Nested union")
                key = b.branch_name
                if key in seen:
                    raise AvroSchemaError(f"Duplicate in union: {key}")
                seen.add(key)
            return AvroType("union", branches=branches)
        if not isinstance(node, dict):
            raise AvroSchemaError(f"Schema not yet supported: {node!r}")
        kind = node.get("type")
        if not isinstance(kind, str):
            if isinstance(kind, (dict, list)):
                return self.parse(kind, namespace)
            raise AvroSchemaError("No type")
        if kind in PRIMITIVES:
            return AvroType(kind)
        if kind in ("record", "error", "enum", "fixed"):
            name = node.get("name")
            if not isinstance(name, str):
                raise AvroSchemaError(f"No name in schema: {json.dumps(node)}")
            space = node.get("namespace", namespace)
            if space is not None and not isinstance(space, str):
                raise AvroSchemaError("namespace must be a string")
            full, inner_space = _fullname(name, space or None)
            if kind in ("record", "error"):
                t = AvroType("record", fullname=full)
                self.define(t)
                raw_fields = node.get("fields")
                if not isinstance(raw_fields, list):
                    raise AvroSchemaError(f"Record has no fields: {json.dumps(node)}")
                seen = set()
                for f in raw_fields:
                    if not isinstance(f, dict) or not isinstance(f.get("name"), str):
                        raise AvroSchemaError("No field name")
                    fname = f["name"]
                    if not _NAME_RE.match(fname):
                        raise AvroSchemaError(f"Illegal name: {fname}")
                    if fname in seen:
                        raise AvroSchemaError(f"Duplicate field {fname} in record {full}")
                    seen.add(fname)
                    if "type" not in f:
                        raise AvroSchemaError(f"No field type: {json.dumps(f)}")
                    ftype = self.parse(f["type"], inner_space)
                    t.fields.append((fname, ftype))
                    if "default" in f:
                        if not _default_fits(ftype, f["default"], self.defaults):
                            raise AvroSchemaError(f"Invalid default for field {fname}: {json.dumps(f['default'])}")
                        self.defaults.setdefault(full, {})[fname] = f["default"]
                return t
            if kind == "enum":
                symbols = node.get("symbols")
                if not isinstance(symbols, list) or not all(isinstance(s, str) for s in symbols):
                    raise AvroSchemaError("Enum symbols must be a list of strings")
                for s in symbols:
                    if not _NAME_RE.match(s):
                        raise AvroSchemaError(f"Illegal name: {s}")
                if len(set(symbols)) != len(symbols):
                    raise AvroSchemaError("Duplicate enum symbol")
                t = AvroType("enum", fullname=full, symbols=list(symbols))
                self.define(t)
                return t
            size = node.get("size")
            if not isinstance(size, int) or isinstance(size, bool) or size < 0:
                raise AvroSchemaError("Invalid or no size")
            t = AvroType("fixed", fullname=full, size=size)
            self.define(t)
            return t
        if kind == "array":
            if "items" not in node:
                raise AvroSchemaError("Array has no items type")
            return AvroType("array", items=self.parse(node["items"], namespace))
        if kind == "map":
            if "values" not in node:
                raise AvroSchemaError("Map has no values type")
            return AvroType("map", values=self.parse(node["values"], namespace))
        return self.lookup(kind, namespace)


_COMMENT_RE = re.compile(r'"(?:[^"\\]|\\.)*"|/\*.*?\*/|//[^\n]*', re.S)


def _without_comments(text: str) -> str:
    """Schema texts may hold ``/* */`` and ``//`` comments; inside strings they are text."""
    return _COMMENT_RE.sub(lambda m: m[0] if m[0].startswith('"') else " ", text)


def _default_fits(t: AvroType, value, defaults: dict) -> bool:
    """Whether ``value`` may be the default of a field of type ``t`` (a union: of any branch)."""
    k = t.kind
    if k == "null":
        return value is None
    if k == "boolean":
        return isinstance(value, bool)
    if k in ("int", "long"):
        return isinstance(value, int) and _integral(value, 32 if k == "int" else 64)
    if k in ("float", "double"):
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    if k in ("string", "bytes", "enum", "fixed"):
        return isinstance(value, str)
    if k == "array":
        return isinstance(value, list) and all(_default_fits(t.items, x, defaults) for x in value)
    if k == "map":
        return isinstance(value, dict) and all(_default_fits(t.values, x, defaults) for x in value.values())
    if k == "union":
        return any(_default_fits(b, value, defaults) for b in t.branches)
    own = defaults.get(t.fullname, {})
    return isinstance(value, dict) and all(
        _default_fits(ft, value.get(n, own.get(n)), defaults) and (n in value or n in own) for n, ft in t.fields)


def parse_schema(text: str) -> AvroType:
    """Parse Avro schema JSON text; raises AvroSchemaError when it is invalid."""
    if text is None:
        raise AvroSchemaError("schema text is missing")
    try:
        node = json.loads(_without_comments(text))
    except json.JSONDecodeError as e:
        raise AvroSchemaError(f"schema is not JSON: {e}") from e
    return _Parser().parse(node, None)


def canonical_form(t: AvroType) -> str:
    """Avro Parsing Canonical Form: full names, only parsing attributes, fixed key order, no blanks."""
    seen: set[str] = set()

    def emit(x: AvroType) -> str:
        if x.kind in PRIMITIVES:
            return json.dumps(x.kind)
        if x.kind == "union":
            return "[" + ",".join(emit(b) for b in x.branches) + "]"
        if x.kind == "array":
            return '{"type":"array","items":' + emit(x.items) + "}"
        if x.kind == "map":
            return '{"type":"map","values":' + emit(x.values) + "}"
        if x.fullname in seen:
            return json.dumps(x.fullname)
        seen.add(x.fullname)
        head = '{"name":' + json.dumps(x.fullname, ensure_ascii=False) + ',"type":"' + x.kind + '"'
        if x.kind == "record":
            parts = ['{"name":' + json.dumps(n, ensure_ascii=False) + ',"type":' + emit(ft) + "}"
                     for n, ft in x.fields]
            return head + ',"fields":[' + ",".join(parts) + "]}"
        if x.kind == "enum":
            return head + ',"symbols":[' + ",".join(json.dumps(s) for s in x.symbols) + "]}"
        return head + ',"size":' + str(x.size) + "}"

    return emit(t)


def _crc64_table() -> list[int]:
    table = []
    for i in range(256):
        fp = i
        for _ in range(8):
            fp = (fp >> 1) ^ (CRC64_EMPTY if fp & 1 else 0)
        table.append(fp)
    return table


_CRC64_TABLE = _crc64_table()


def fingerprint(t: AvroType) -> str:
    """Lower-hex CRC-64-AVRO of the canonical form, bytes in little-endian order."""
    fp = CRC64_EMPTY
    for b in canonical_form(t).encode("utf-8"):
        fp = (fp >> 8) ^ _CRC64_TABLE[(fp ^ b) & 0xFF]
    return fp.to_bytes(8, "little").hex()


def is_recursive(t: AvroType) -> bool:
    """True when a named type refers to itself (cannot be unrolled into one Column)."""
    def walk(x: AvroType, stack: tuple) -> bool:
        if x.is_named:
            if x.fullname in stack:
                return True
            stack = stack + (x.fullname,)
        children = [ft for _, ft in x.fields] + list(x.branches)
        children += [c for c in (x.items, x.values) if c is not None]
        return any(walk(c, stack) for c in children)
    return walk(t, ())


# ---------------------------------------------------------------------------
# Pure-Python conformity check of a parsed JSON value (Avro JSON encoding).
# Used per row only for self-recursive schemas, and by the tests as a brute-force
# oracle for the Column predicate.
# ---------------------------------------------------------------------------

def _integral(value, bits: int) -> bool:
    """As :func:`tidewater.plans.predicate.is_integral`, for a value that ``json`` has read."""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return False
    if isinstance(value, int):
        return -(2 ** (bits - 1)) <= value < 2 ** (bits - 1)
    if bits == 32 and abs(value) < 3.5e38:
        value = struct.unpack("f", struct.pack("f", value))[0]
    return value == value and abs(value) <= 2 ** (bits - 1) and value.is_integer()


def conforms_value(t: AvroType, value) -> bool:
    k = t.kind
    if k == "null":
        return value is None
    if k == "boolean":
        return isinstance(value, bool)
    if k == "int":
        return _integral(value, 32)
    if k == "long":
        return _integral(value, 64)
    if k in ("float", "double"):
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    if k in ("string", "bytes"):
        return isinstance(value, str)
    if k == "enum":
        return isinstance(value, str) and value in t.symbols
    if k == "fixed":
        return isinstance(value, str) and len(value) == t.size
    if k == "array":
        return isinstance(value, list) and all(conforms_value(t.items, e) for e in value)
    if k == "map":
        return isinstance(value, dict) and all(conforms_value(t.values, e) for e in value.values())
    if k == "record":
        return isinstance(value, dict) and all(n in value and conforms_value(ft, value[n]) for n, ft in t.fields)
    if k == "union":
        if value is None:
            return any(b.kind == "null" for b in t.branches)
        if not isinstance(value, dict) or len(value) != 1:
            return False
        (key, inner), = value.items()
        return any(b.kind != "null" and b.branch_name == key and conforms_value(b, inner) for b in t.branches)
    return False


def _no_duplicate_keys(pairs):
    keys = [k for k, _ in pairs]
    if len(keys) != len(set(keys)):
        raise ValueError("duplicate key")
    return dict(pairs)


def conforms_text(t: AvroType, body: str | None) -> bool:
    """Whole-body check: the root must decode as a record (directly or via a union branch)."""
    if body is None:
        return False
    try:
        value, _end = json.JSONDecoder(object_pairs_hook=_no_duplicate_keys).raw_decode(body.lstrip())
    except ValueError:
        return False
    if t.kind == "record":
        return conforms_value(t, value)
    if t.kind == "union" and isinstance(value, dict) and len(value) == 1:
        (key, inner), = value.items()
        return any(b.kind == "record" and b.fullname == key and conforms_value(b, inner) for b in t.branches)
    return False
