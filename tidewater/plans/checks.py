"""Schema conformity as data: a flat check program per schema, one expression for all.

Compiling every schema into its own Column (``plans.predicate``) would make the gate's
expression grow with the number of distinct schemas.  Here a schema is flattened on the
driver into a list of checks, each naming a variant path from the document root and
what must hold there.  The list rides on the broadcast route row, and a single
constant-size ``forall`` evaluates whichever program the row's route carries.

Covered: records (any depth), the primitive types, enum, fixed, arrays and maps of
those or of records (one level: the element carries its own program), and
``["null", T]`` unions whose T is a scalar or a record.  A schema using anything
else (a union with two non-null branches, containers nested inside containers)
has no flat program and gets a table of nodes (``plans.tree_checks``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.plans.avro import AvroType
from tidewater.plans.predicate import variant_path

_LEAF_FIELDS = [
    T.StructField("path", T.StringType()),        # variant path from the document (or element) root
    T.StructField("kind", T.StringType()),        # what must hold at the path
    T.StructField("inner", T.StringType()),       # element kind (array/map) or branch kind (nullable)
    T.StructField("tag_path", T.StringType()),    # nullable: path of the tagged branch value
    T.StructField("symbols", T.ArrayType(T.StringType())),
    T.StructField("size", T.IntegerType()),
    T.StructField("guards", T.ArrayType(T.StringType())),   # vacuous when any guard path holds JSON null
]
CHECK_LEAF = T.StructType(_LEAF_FIELDS)
# Arrays / maps of records carry the record's own program, paths relative to each element.
CHECK = T.StructType(_LEAF_FIELDS + [T.StructField("element", T.ArrayType(CHECK_LEAF))])
CHECKS = T.ArrayType(CHECK)

_SCALAR = {"string": "string", "bytes": "string", "int": "int", "long": "long", "float": "number",
           "double": "number", "boolean": "boolean", "null": "null", "enum": "enum", "fixed": "fixed"}


class _Complex(Exception):
    pass


def _scalar(t: AvroType) -> tuple[str, list | None, int | None]:
    kind = _SCALAR.get(t.kind)
    if kind is None:
        raise _Complex(t.kind)
    return kind, (list(t.symbols) if t.kind == "enum" else None), (t.size if t.kind == "fixed" else None)


def _record_checks(record: AvroType, nested: bool) -> list[dict]:
    """Checks for a record at the root of the document (or of a container element)."""
    out: list[dict] = []

    def add(path, kind, guards, inner=None, tag_path=None, symbols=None, size=None, element=None):
        check = {"path": variant_path(path), "kind": kind, "inner": inner, "tag_path": tag_path,
                 "symbols": symbols, "size": size, "guards": list(guards)}
        if not nested:
            check["element"] = element
        out.append(check)

    def walk(t: AvroType, path: list, guards: tuple):
        if variant_path(path) is None:
            raise _Complex("path")
        if t.kind == "record":
            if not t.fields:
                add(path, "object", guards)
            for name, ftype in t.fields:
                walk(ftype, path + [name], guards)
        elif t.kind in ("array", "map"):
            item = t.items if t.kind == "array" else t.values
            if item.kind == "record":
                if nested:
                    raise _Complex("containers of records inside containers")
                add(path, t.kind + "_records", guards, element=_record_checks(item, nested=True))
            else:
                kind, symbols, size = _scalar(item)
                add(path, t.kind, guards, inner=kind, symbols=symbols, size=size)
        elif t.kind == "union":
            rest = [b for b in t.branches if b.kind != "null"]
            if len(rest) != 1 or len(t.branches) != 2:
                raise _Complex("union")
            branch = rest[0]
            tag = path + [branch.branch_name]
            if variant_path(tag) is None:
                raise _Complex("path")
            if branch.kind == "record":
                add(path, "nullable_record", guards, tag_path=variant_path(tag))
                for name, ftype in branch.fields:
                    walk(ftype, tag + [name], guards + (variant_path(path),))
            else:
                kind, symbols, size = _scalar(branch)
                add(path, "nullable", guards, inner=kind, tag_path=variant_path(tag), symbols=symbols, size=size)
        else:
            kind, symbols, size = _scalar(t)
            add(path, kind, guards, symbols=symbols, size=size)

    walk(record, [], ())
    return out


def program(schema: AvroType) -> list[dict] | None:
    """The check list for a record-rooted schema, or None when it needs a table of nodes."""
    if schema.kind != "record":
        return None
    try:
        return _record_checks(schema, nested=False)
    except _Complex:
        return None


# The evaluation is one constant SQL text: building it out of Column calls would cost seconds a plan, and every value
# is bound to a lambda's field once instead of being spelled out again wherever it is looked at.

_INTEGERS = "'BIGINT', 'INT', 'SMALLINT', 'TINYINT'"


def integral_sql(x: str, k: str, bits: int) -> str:
    """:func:`tidewater.plans.predicate.is_integral` as SQL over the value ``x`` and its kind ``k``."""
    narrow, wide = ("int", "float") if bits == 32 else ("bigint", "double")
    whole = f"try_variant_get({x}, '$', '{narrow}') IS NOT NULL"
    f = f"cast(try_variant_get({x}, '$', '{wide}') AS double)"
    return (f"(CASE WHEN {k} IN ({_INTEGERS}) OR ({k} LIKE 'DECIMAL%' AND {k} LIKE '%,0)') THEN {whole} "
            f"WHEN {k} IN ('DOUBLE', 'FLOAT') OR {k} LIKE 'DECIMAL%' THEN {f} = rint({f}) AND abs({f}) <= {float(2 ** (bits - 1))!r}D "
            "ELSE false END)")


def leaf_sql(x: str, k: str, kind: str, symbols: str, size: str) -> str:
    """One value ``x`` of kind ``k`` (its ``schema_of_variant``) against a scalar kind; NULL counts as no."""
    text = f"try_variant_get({x}, '$', 'string')"
    return (f"(CASE {kind} WHEN 'string' THEN {k} = 'STRING' WHEN 'int' THEN {integral_sql(x, k, 32)} WHEN 'long' THEN {integral_sql(x, k, 64)} "
            f"WHEN 'number' THEN {k} IN ({_INTEGERS}, 'DOUBLE', 'FLOAT') OR {k} LIKE 'DECIMAL%' "
            f"WHEN 'boolean' THEN {k} = 'BOOLEAN' WHEN 'null' THEN is_variant_null({x}) "
            f"WHEN 'enum' THEN {k} = 'STRING' AND array_contains({symbols}, {text}) "
            f"WHEN 'fixed' THEN {k} = 'STRING' AND length({text}) = {size} "
            f"WHEN 'object' THEN try_cast({x} AS map<string,variant>) IS NOT NULL ELSE false END)")


def _run_sql(v: str, checks: str, nested: bool = False) -> str:
    """``v`` passes all of ``checks``: each check's value is fetched once, its kind once, then judged."""
    c, s, e, g = ("c2", "s2", "e2", "g2") if nested else ("c1", "s1", "e1", "g1")
    held = (f"transform({checks}, {c} -> named_struct('c', {c}, "
            f"'free', exists({c}.guards, {g} -> coalesce(is_variant_null(try_variant_get({v}, {g}, 'variant')), false)), "
            f"'x', try_variant_get({v}, {c}.path, 'variant'), "
            f"'y', CASE WHEN {c}.kind = 'nullable' THEN try_variant_get({v}, {c}.tag_path, 'variant') "
            f"WHEN {c}.kind NOT IN ('array', 'map', 'array_records', 'map_records', 'nullable_record', 'object') THEN try_variant_get({v}, {c}.path, 'variant') END))")
    elements = (f"CASE WHEN {s}.c.kind LIKE 'array%' THEN try_cast({s}.x AS array<variant>) "
                f"ELSE map_values(try_cast({s}.x AS map<string,variant>)) END")
    leaves = f"coalesce(forall({elements}, {e} -> coalesce({leaf_sql(e, f'schema_of_variant({e})', f'{s}.c.inner', f'{s}.c.symbols', f'{s}.c.size')}, false)), false)"
    one_key = f"size(try_cast({s}.x AS map<string,variant>)) = 1"
    scalar = leaf_sql(f"{s}.y", f"schema_of_variant({s}.y)", f"CASE {s}.c.kind WHEN 'nullable' THEN {s}.c.inner ELSE {s}.c.kind END",
                      f"{s}.c.symbols", f"{s}.c.size")
    body = f"WHEN {s}.c.kind IN ('array', 'map') THEN {leaves} "
    if not nested:
        body += (f"WHEN {s}.c.kind IN ('array_records', 'map_records') THEN "
                 f"coalesce(forall({elements}, {e} -> {_run_sql(e, f'{s}.c.element', nested=True)}), false) ")
    body += (f"WHEN {s}.c.kind = 'object' THEN try_cast({s}.x AS map<string,variant>) IS NOT NULL "
             f"WHEN {s}.c.kind = 'nullable_record' THEN is_variant_null({s}.x) OR ({one_key} AND "
             f"try_cast(try_variant_get({v}, {s}.c.tag_path, 'variant') AS map<string,variant>) IS NOT NULL) "
             f"WHEN {s}.c.kind = 'nullable' THEN is_variant_null({s}.x) OR ({one_key} AND {scalar}) ELSE {scalar} END")
    return f"forall({held}, {s} -> coalesce(CASE WHEN {s}.free THEN true {body}, false))"


_PROGRAM = f"r0 -> coalesce(r0.v IS NOT NULL AND {_run_sql('r0.v', 'r0.checks')}, false)"


def run(v: Column, checks: Column) -> Column:
    """Boolean Column: the parsed body ``v`` passes every check of the row's program."""
    return F.call_function("exists", F.array(F.struct(v.alias("v"), checks.alias("checks"))), F.expr(_PROGRAM))
