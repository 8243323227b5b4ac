"""RFC 6901 JSON Pointer: tokenising (driver, per route) and resolution (Column, per row).

A token addresses an object member by name or an array element by index.  A
token like ``1`` could be either; each step tries the member, then the element of
what the steps before it reached.  JSON ``null`` counts as a value (``variant_get`` returns a variant null, not SQL NULL).
"""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.plans.predicate import variant_path

_INDEX_RE = re.compile(r"^[+]?[0-9]+$")
_INT_MAX = 2 ** 31 - 1


class PointerError(ValueError):
    """The pointer is not an RFC 6901 pointer."""


# Fixed value: the message a pointer without a leading "/" reports.
NOT_A_POINTER = "jsonExpressionPointer '{pointer}' must be an RFC 6901 JSON Pointer starting with '/', e.g. '/payload'"


def normalise(pointer: str | None) -> str | None:
    """Blank or empty pointer means "whole document": stored as NULL once, at route load."""
    if pointer is None or not pointer.strip():
        return None
    return pointer


def segments(pointer: str | None) -> list[str]:
    """Split into unescaped tokens; ``~1`` is unescaped before ``~0``."""
    if pointer is None or not pointer.strip():
        return []
    expression = pointer.strip()
    if not expression.startswith("/"):
        raise PointerError(NOT_A_POINTER.format(pointer=expression))
    return [t.replace("~1", "/").replace("~0", "~") for t in expression.split("/")[1:]]


def _array_index(token: str) -> int | None:
    if _INDEX_RE.match(token):
        n = int(token)
        return n if n <= _INT_MAX else None
    return None


# One token as data: a member name, its variant path where it has one, and its array index path.
STEPS = T.ArrayType(T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("member", T.StringType()),
    T.StructField("element", T.StringType()),
]))


def steps(tokens: list[str]) -> list[dict]:
    """The tokens for :func:`follow`: linear in the pointer, however many tokens are numeric."""
    out = []
    for t in tokens:
        index = _array_index(t)
        out.append({"name": t, "member": variant_path([t]), "element": None if index is None else variant_path([index])})
    return out


def follow(v: Column, path: Column) -> Column:
    """Resolve ``v`` step by step (``path``: an array of :data:`STEPS`); SQL NULL when it selects nothing.

    A value is an object or an array, so at most one reading of a numeric token finds something.
    Member names that hold both quote kinds have no path syntax and are looked up in a map.
    """
    def step(here: Column, s: Column) -> Column:
        by_name = F.when(s["member"].isNotNull(), F.try_variant_get(here, s["member"], "variant")) \
            .otherwise(F.try_element_at(here.try_cast("map<string,variant>"), s["name"]))
        return F.coalesce(by_name, F.when(s["element"].isNotNull(), F.try_variant_get(here, s["element"], "variant")))

    return F.aggregate(path, v, step)


#: Numeric tokens up to which a pointer is spelled out as whole paths: each doubles them.
_MOST_NUMERIC = 2


def paths(tokens: list[str]) -> list[str] | None:
    """Whole variant paths of the pointer, one for each reading of its numeric tokens (at most one finds something), or None
    where a member name has no path syntax or the readings are too many."""
    readings = [[t] if (n := _array_index(t)) is None else [t, n] for t in tokens]
    if sum(len(r) > 1 for r in readings) > _MOST_NUMERIC:
        return None
    out = [variant_path(list(r)) for r in product(*readings)]
    return None if None in out else out


def resolve(v: Column, tokens: list[str]) -> Column:
    """The variant the pointer selects, SQL NULL when it selects nothing."""
    if not tokens:
        return v
    whole = paths(tokens)
    if whole is not None:
        return F.coalesce(*[F.try_variant_get(v, p, "variant") for p in whole])
    literal = F.array(*[F.struct(*[F.lit(s[k]).cast("string").alias(k) for k in ("name", "member", "element")])
                        for s in steps(tokens)])
    return follow(v, literal)


def extract_text(v: Column, tokens: list[str]) -> Column:
    """Compact JSON text of the selected value (the pointer's "extract")."""
    return F.to_json(resolve(v, tokens))
