"""Route compile (D12): flattened route rows → compiled routes + the broadcast join side.

Routes are configuration (one row per producer endpoint), so compiling them on
the driver is bounded by the route count, never by the data.  Each route gets
its schema identity, the conformity predicate key, the pointer tokens, and its
target layout; failures become ``route_errors`` rows instead of stopping others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions import pointer as jp
from tidewater.plans import avro, checks as CK, layout, tree_checks as TC
from tidewater.settings import Settings

OK = "ok"
SCHEMA_INVALID = "schema_invalid"          # served without validation or fingerprint
POINTER_INVALID = "pointer_invalid"        # requests rejected with invalid_route
RECURSIVE = "recursive"                     # a type refers to itself


@dataclass
class CompiledRoute:
    route_name: str
    producer: str
    schema_subject: str
    schema_version: int
    payload_schema: str | None = None
    pointer: str | None = None
    iceberg: dict | None = None
    schema: avro.AvroType | None = None
    fingerprint: str | None = None
    compile_status: str = OK                  # the last finding, for reports; what rules is below
    recursive: bool = False                   # of the schema
    pointer_valid: bool = True                # of the pointer
    tokens: list = field(default_factory=list)
    columns: list | None = None               # target layout, when the route has a target
    checks: list | None = None                # flat conformity program, when the schema allows one
    nodes: list | None = None                 # ... otherwise its node table
    levels: int | None = None                 # ... and the levels it takes, where they do not depend on the document
    errors: list = field(default_factory=list)  # (stage, message)

    @property
    def has_target(self) -> bool:
        return self.iceberg is not None

    @property
    def validates(self) -> bool:
        return self.schema is not None

    @property
    def renames(self) -> bool:
        return self.has_target and self.pointer is None


ROUTE_COLUMNS = T.StructType([
    T.StructField("api_version", T.StringType()),
    T.StructField("producer", T.StringType()),
    T.StructField("route_name", T.StringType()),
    T.StructField("schema_subject", T.StringType()),
    T.StructField("schema_version", T.IntegerType()),
    T.StructField("schema_fingerprint", T.StringType()),
    T.StructField("schema_key", T.StringType()),
    T.StructField("pointer", T.StringType()),
    T.StructField("pointer_ok", T.BooleanType()),
    T.StructField("has_target", T.BooleanType()),
    T.StructField("rename", T.BooleanType()),
    T.StructField("compile_status", T.StringType()),
    T.StructField("schema_checks", CK.CHECKS),
    T.StructField("pointer_steps", jp.STEPS),
    T.StructField("pointer_paths", T.ArrayType(T.StringType())),
    T.StructField("schema_nodes", TC.NODES),
    T.StructField("schema_levels", T.IntegerType()),
])

ROUTE_ERRORS = T.StructType([
    T.StructField("route_name", T.StringType()),
    T.StructField("producer", T.StringType()),
    T.StructField("stage", T.StringType()),
    T.StructField("message", T.StringType()),
])


def compile_route(row: dict, settings: Settings) -> CompiledRoute:
    r = CompiledRoute(route_name=row["route_name"], producer=row["producer"],
                      schema_subject=row["schema_subject"], schema_version=int(row["schema_version"]),
                      payload_schema=row.get("payload_schema"), pointer=jp.normalise(row.get("pointer")),
                      iceberg=row.get("iceberg"))
    if r.payload_schema is not None:
        try:
            r.schema = avro.parse_schema(r.payload_schema)
            r.fingerprint = avro.fingerprint(r.schema)
            r.recursive = avro.is_recursive(r.schema)
            if r.recursive:
                r.compile_status = RECURSIVE
            else:
                r.checks = CK.program(r.schema)
            if r.checks is None:
                r.nodes, r.levels = TC.program(r.schema), TC.levels(r.schema)
        except avro.AvroSchemaError as e:
            r.schema = None
            r.compile_status = SCHEMA_INVALID
            r.errors.append(("schema", f"payloadSchema of {r.producer} is no Avro schema ({e}); bodies go unchecked"))
    try:
        r.tokens = jp.segments(r.pointer)
    except jp.PointerError as e:
        r.pointer_valid = False
        r.compile_status = POINTER_INVALID
        r.errors.append(("pointer", str(e)))
    if r.has_target and r.pointer_valid:
        hand = [(c["name"], c["type"]) for c in (r.iceberg.get("columns") or [])]
        try:
            cols = layout.resolve_columns(r.payload_schema, hand, r.pointer, settings.merge_key)
            for c in cols:
                layout.spark_type(c.type, c.name)
            r.columns = cols
        except (layout.LayoutError, avro.AvroSchemaError, jp.PointerError) as e:
            r.errors.append(("layout", str(e)))
    return r


def _as_dict(row) -> dict:
    d = row.asDict(recursive=True)
    return d


@dataclass
class RouteTable:
    routes: list[CompiledRoute]
    settings: Settings
    duplicates: list[CompiledRoute] = field(default_factory=list)

    def by_producer(self) -> dict[str, CompiledRoute]:
        return {r.producer: r for r in self.routes}

    def schemas(self) -> dict[str, CompiledRoute]:
        """One representative route per distinct validating schema (keyed by fingerprint)."""
        out: dict[str, CompiledRoute] = {}
        for r in self.routes:
            if r.validates:
                out.setdefault(r.fingerprint, r)
        return out

    def rows(self) -> list[tuple]:
        s = self.settings
        return [(s.api_version, r.producer, r.route_name, r.schema_subject, r.schema_version, r.fingerprint,
                 r.fingerprint if r.validates else None, r.pointer, r.pointer_valid,
                 r.has_target, r.renames, r.compile_status, r.checks if r.validates else None,
                 jp.steps(r.tokens) if r.tokens else None, jp.paths(r.tokens) if r.tokens else None,
                 r.nodes if r.validates else None, r.levels) for r in self.routes]

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), ROUTE_COLUMNS)

    def estimated_bytes(self) -> int:
        """Size estimate of the join side from the rows themselves (they are on the driver already)."""
        return sum(len(repr(row)) for row in self.rows())

    def broadcastable(self) -> bool:
        return (len(self.routes) <= self.settings.route_broadcast_limit
                and self.estimated_bytes() <= self.settings.route_broadcast_bytes)

    def join_side(self, spark: SparkSession) -> DataFrame:
        """Routes for the request join: broadcast only when both the (known) route count and the
        estimated size are within their limits; otherwise a shuffle join."""
        df = self.to_df(spark)
        return F.broadcast(df) if self.broadcastable() else df

    def errors_df(self, spark: SparkSession) -> DataFrame:
        rows = [(r.route_name, r.producer, stage, msg) for r in self.routes for stage, msg in r.errors]
        rows += [(r.route_name, r.producer, "duplicate_producer",
                  f"producer {r.producer} is already served by another route") for r in self.duplicates]
        return spark.createDataFrame(rows, ROUTE_ERRORS)


def compile_routes(routes: DataFrame, settings: Settings) -> RouteTable:
    """Compile flattened routes.  Two routes naming one producer: the first by route name wins."""
    return _compile([_as_dict(r) for r in routes.collect()], settings)


def _compile(rows: list[dict], settings: Settings) -> RouteTable:
    served: dict[str, CompiledRoute] = {}
    dups: list[CompiledRoute] = []
    for row in sorted(rows, key=lambda r: r["route_name"]):
        compiled = compile_route(row, settings)
        if compiled.producer in served:
            dups.append(compiled)
        else:
            served[compiled.producer] = compiled
    ordered = sorted(served.values(), key=lambda r: r.producer)
    return RouteTable(ordered, settings, dups)


def watched_routes(load: Callable[[], DataFrame], settings: Settings) -> Callable[[], RouteTable]:
    """A ``routes`` callable for streams: reads the routes each time, compiles them when they changed."""
    last: list = [None, None]

    def routes() -> RouteTable:
        rows = sorted((_as_dict(r) for r in load().collect()), key=repr)
        if rows != last[0]:
            last[:] = [rows, _compile(rows, settings)]
        return last[1]

    return routes
