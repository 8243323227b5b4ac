"""Schema conformity as a program with jump targets, for schemas that a flat list of checks cannot say.

A schema becomes a table of nodes that refer to each other by number, so a type that refers to itself is a jump back.
The table rides on the route's row.  A document is checked level by level: the frontier starts as the whole body at node
0, and each level replaces every (value, node) pair by its children, or by nothing where a scalar passes, or by a failure
that stays.  What is left after the last level says the verdict.  The expression is one constant SQL text, whatever the
number of routes, schemas and branches and however deep types nest.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.plans.avro import AvroType, is_recursive
from tidewater.plans.checks import _SCALAR, leaf_sql
from tidewater.plans.predicate import variant_path

NODE = T.StructType([
    T.StructField("kind", T.StringType()),          # record, array, map, union or a scalar kind
    T.StructField("fields", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()), T.StructField("path", T.StringType()), T.StructField("node", T.IntegerType())]))),
    T.StructField("item", T.IntegerType()),         # of an array's elements or a map's values
    T.StructField("branches", T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), T.StructField("node", T.IntegerType())]))),
    T.StructField("nullable", T.BooleanType()),     # a union with a null branch
    T.StructField("symbols", T.ArrayType(T.StringType())),
    T.StructField("size", T.IntegerType()),
])
NODES = T.ArrayType(NODE)

#: Variants nest no deeper than their parser allows.
MOST_LEVELS = 1002


def program(schema: AvroType) -> list[dict]:
    """The node table of any schema; its root must decode as a record, alone or through a union's branch."""
    nodes: list = []
    numbers: dict = {}

    def number(t: AvroType) -> int:
        key = t.fullname if t.is_named else (t.kind if t.kind in _SCALAR else id(t))
        if key not in numbers:
            numbers[key] = len(nodes)
            nodes.append(None)
            nodes[numbers[key]] = node(t)
        return numbers[key]

    def node(t: AvroType, root: bool = False) -> dict:
        out = dict.fromkeys(NODE.fieldNames())
        out["kind"] = _SCALAR.get(t.kind, t.kind)
        if t.kind == "record":
            out["fields"] = [{"name": n, "path": variant_path([n]), "node": number(f)} for n, f in t.fields]
        elif t.kind in ("array", "map"):
            out["item"] = number(t.items if t.kind == "array" else t.values)
        elif t.kind == "union":
            out["nullable"] = not root and any(b.kind == "null" for b in t.branches)
            out["branches"] = [{"tag": b.branch_name, "node": number(b)} for b in t.branches
                               if (b.kind == "record" if root else b.kind != "null")]
        elif t.kind == "enum":
            out["symbols"] = list(t.symbols)
        elif t.kind == "fixed":
            out["size"] = t.size
        return out

    if schema.kind == "record":
        number(schema)
    else:
        nodes.append(None)
        nodes[0] = node(schema, root=True) if schema.kind == "union" else {**dict.fromkeys(NODE.fieldNames()), "kind": "never"}
    return nodes


def levels(schema: AvroType) -> int | None:
    """Levels that any document of the schema takes; None where they depend on the document."""
    if is_recursive(schema):
        return None

    def depth(t: AvroType) -> int:
        below = [f for _, f in t.fields] + list(t.branches) + [c for c in (t.items, t.values) if c is not None]
        return 1 + max(map(depth, below), default=0)

    return depth(schema)


_FAIL = "array(named_struct('v', cast(NULL AS variant), 'n', -1))"
_NONE = f"filter({_FAIL}, z0 -> false)"
_MAP = "try_cast(f0.v AS map<string,variant>)"
_CHILDREN = f"""CASE n0.kind
  WHEN 'record' THEN CASE WHEN {_MAP} IS NULL THEN {_FAIL} ELSE transform(n0.fields, d0 -> named_struct(
    'v', CASE WHEN d0.path IS NULL THEN try_element_at({_MAP}, d0.name) ELSE try_variant_get(f0.v, d0.path, 'variant') END, 'n', d0.node)) END
  WHEN 'array' THEN coalesce(transform(try_cast(f0.v AS array<variant>), e0 -> named_struct('v', e0, 'n', n0.item)), {_FAIL})
  WHEN 'map' THEN coalesce(transform(map_values({_MAP}), e1 -> named_struct('v', e1, 'n', n0.item)), {_FAIL})
  WHEN 'union' THEN CASE WHEN coalesce(is_variant_null(f0.v), false) THEN CASE WHEN n0.nullable THEN {_NONE} ELSE {_FAIL} END
    ELSE transform(array({_MAP}), m0 -> CASE WHEN size(m0) = 1 AND exists(n0.branches, b0 -> b0.tag = map_keys(m0)[0])
      THEN transform(filter(n0.branches, b1 -> b1.tag = map_keys(m0)[0]), b2 -> named_struct('v', map_values(m0)[0], 'n', b2.node))
      ELSE {_FAIL} END)[0] END
  ELSE CASE WHEN coalesce({leaf_sql('f0.v', 'schema_of_variant(f0.v)', 'n0.kind', 'n0.symbols', 'n0.size')}, false) THEN {_NONE} ELSE {_FAIL} END END"""
_STEP = f"""transform(array(flatten(transform(a0, f0 -> transform(array(get(r0.nodes, f0.n)), n0 -> {_CHILDREN})[0]))),
  x0 -> CASE WHEN exists(x0, y0 -> y0.n < 0) THEN {_FAIL} ELSE x0 END)[0]"""
_OPENERS = "length(r0.body) - length(translate(r0.body, '{[', ''))"
_PROGRAM = f"""r0 -> coalesce(r0.v IS NOT NULL AND size(aggregate(sequence(1, coalesce(r0.levels, least({_OPENERS} + 2, {MOST_LEVELS}))),
  array(named_struct('v', r0.v, 'n', 0)), (a0, i0) -> {_STEP})) = 0, false)"""


def run(v: Column, body: Column, nodes: Column, level_count: Column) -> Column:
    """Boolean Column: the parsed body ``v`` decodes under the row's node table.  ``level_count`` is NULL where it depends on
    the document: no document nests deeper than it has opening brackets."""
    row = F.struct(v.alias("v"), body.alias("body"), nodes.alias("nodes"), level_count.cast("int").alias("levels"))
    return F.call_function("exists", F.array(row), F.expr(_PROGRAM))
