"""Pull landed rows into a target table.

One producer's new rows are those of batches committed since the last run (C7; :func:`pull` reads them by
``ts > watermark`` instead, with partition pruning and Parquet min/max pushdown), each payload is exploded when it is an
array (C1), the route's pointer applied (C2), members decoded into the target's
typed columns with containers kept as variant (C3, C6), the envelope appended
(C4), and the batch merged by key into the target (C5).  The watermark lives in
the table comment.

Envelope values always come from the landed row, also where the target declares
columns of their names: what a producer writes into its documents moves neither the
merge key nor the watermark.  An element of an array body has a key of its own.
"""

from __future__ import annotations

import json
import uuid
import datetime as dt
from dataclasses import replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import pointer as jp
from tidewater.operators.landing import incremental_pull, utc_literal
from tidewater.operators.manifest import PositionLog, past, read_new
from tidewater.plans import layout
from tidewater.session import materialised
from tidewater.plans.predicate import variant_path
from tidewater.settings import COMMENT_PROPERTY, TIMESTAMP_COLUMN


class WatermarkError(RuntimeError):
    """The target table has no readable watermark; refuse to pull."""


def parse_watermark(comment: str | None) -> dt.datetime:
    if not comment:
        raise WatermarkError("Invalid watermark value: table has no comment")
    try:
        value = json.loads(comment)["timestamp"]
        return dt.datetime.fromisoformat(value.replace("Z", "+00:00")).astimezone(dt.timezone.utc).replace(
            tzinfo=None)
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise WatermarkError(f"Invalid watermark value: {comment!r}") from e


def render_watermark(ts: dt.datetime) -> str:
    return json.dumps({"timestamp": ts.strftime("%Y-%m-%dT%H:%M:%S.%fZ")}, separators=(",", ":"))


def table_comment(spark: SparkSession, table: str) -> str | None:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()
    for r in rows:
        if (r["col_name"] or "").strip() == "Comment":
            return r["data_type"]
    return None


def table_property(spark: SparkSession, table: str, key: str) -> str | None:
    rows = spark.sql(f"SHOW TBLPROPERTIES {table}").collect()
    for r in rows:
        if r["key"] == key:
            return r["value"]
    return None


def read_watermark(spark: SparkSession, table: str) -> dt.datetime:
    return parse_watermark(table_comment(spark, table))


def advance_watermark(spark: SparkSession, table: str, ts: dt.datetime) -> None:
    """After a committed merge, move the watermark to the newest pulled arrival."""
    text = render_watermark(ts).replace("'", "\\'")
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{COMMENT_PROPERTY}' = '{text}')")


def explode_payload(landed: DataFrame) -> DataFrame:
    """One row per document: an array payload yields its elements, anything else itself.
    ``doc_key`` names the document: the landed id, with the position for an array's elements."""
    v = F.try_parse_json(F.col("payload"))
    elements = v.try_cast("array<variant>")
    keyed = F.concat_ws("-", F.col("id"), F.col("doc_pos").cast("string")) if "id" in landed.columns else F.lit(None).cast("string")
    rows = landed.select("*", elements.isNotNull().alias("_in_array"),
                         F.posexplode(F.coalesce(elements, F.array(v))).alias("doc_pos", "doc"))
    single = F.col("id") if "id" in landed.columns else F.lit(None).cast("string")
    return rows.withColumn("doc_key", F.when(F.col("_in_array"), keyed).otherwise(single)).drop("_in_array")


def apply_pointer(df: DataFrame, pointer: str | None) -> DataFrame:
    """Replace ``doc`` by what the route's pointer selects."""
    tokens = jp.segments(pointer)
    if not tokens:
        return df
    return df.withColumn("doc", jp.resolve(F.col("doc"), tokens))


def decode_member(doc: Column, col: layout.Column) -> Column:
    """Typed value of one member; nullable-union values may arrive tagged."""
    if col.renamed is not None:
        return F.coalesce(decode_member(doc, replace(col, renamed=None)), decode_member(doc, replace(col, source=col.renamed, renamed=None)))
    t = layout.spark_type(col.type, col.name)
    target = "variant" if isinstance(t, type(layout.COLUMN_TYPES["variant"])) else t.simpleString()
    # Avro's JSON encoding writes each byte of ``bytes`` as the character of its number
    read, done = ("string", lambda c: F.encode(c, "ISO-8859-1")) if target == "binary" else (target, lambda c: c)
    path = variant_path([col.source])
    if path is None:
        member = F.try_element_at(doc.try_cast("map<string,variant>"), F.lit(col.source))
        return member if target == "variant" else done(member.try_cast(read))
    plain = F.try_variant_get(doc, path, read)
    if col.union_tag is None:
        return done(plain)
    tagged = F.try_variant_get(doc, variant_path([col.source, col.union_tag]), read)
    return done(F.coalesce(tagged, plain))


def decode(df: DataFrame, columns: list[layout.Column], merge_key: str) -> DataFrame:
    """Project documents onto the target columns, envelope values in theirs."""
    envelope = {TIMESTAMP_COLUMN.lower(): "timestampUTC", merge_key.lower(): "doc_key"}
    out = []
    for c in columns:
        landed = envelope.get(c.name.lower())
        value = decode_member(F.col("doc"), c) if landed is None else F.col(landed).cast(layout.spark_type(c.type, c.name))
        out.append(value.alias(c.name))
    return df.select(*out)


def merge(target: DataFrame | None, incoming: DataFrame, key: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """Upsert by key, newest by ``order`` wins.

    A union plus a keyed ``max_by`` aggregate: Spark plans it as a partial aggregate
    before the shuffle and a final one after, so a hot key is collapsed map-side and
    never reaches one task whole.  ``merge_into_table`` writes and swaps the result.

    With ``parts`` the rows are dealt by key to so many tasks, which sort them once: for merges of mostly distinct keys,
    where a partial aggregate saves little and the session's shuffle partitions would hold more than a task should sort.
    """
    rows = incoming if target is None else target.unionByName(incoming)
    if parts is not None:
        rows = rows.repartition(parts, *key)
    others = [c for c in rows.columns if c not in key]
    agg = rows.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*[F.col(c) for c in order])).alias("_w"))
    return agg.select(*key, *[F.col("_w")[c].alias(c) for c in others])


def table_location(spark: SparkSession, table: str) -> str:
    for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect():
        if (r["col_name"] or "").strip() == "Location":
            return r["data_type"]
    raise RuntimeError(f"table {table} has no location")


def merge_into_table(spark: SparkSession, table: str, incoming: DataFrame, key: list[str], order: list[str],
                     version: int | None = None) -> str:
    """Merge ``incoming`` into a Parquet target (C5) and swap the table to the result.

    Parquet tables refuse MERGE INTO, and a job may not overwrite the files it reads,
    so the merged rows are written to a new versioned folder beside the current one
    (in the table's own, shared storage) and the table is pointed at it.  The write
    also cuts the lineage: the next merge starts from files, not from this plan.
    A bucketed target (:func:`create_bucketed_target`) has only its touched buckets rewritten, and Iceberg targets
    run ``MERGE INTO``.
    """
    if _provider(spark, table) == "iceberg":
        return _merge_into_iceberg(spark, table, incoming, key, order)
    if table_property(spark, table, BUCKETS_PROPERTY) is not None:
        merge_buckets(spark, table, incoming, key, order)
        return table_location(spark, table)
    current = table_location(spark, table).rstrip("/")
    base, _, tail = current.rpartition("/_v")
    if not base or not tail.isdigit():
        base, tail = current, "0"
    if version is None:
        version = int(tail) + 1
    target = f"{base}/_v{version}"
    if target == current:
        raise ValueError(f"merge target {target} is the table's current location; use a new version")
    cols = spark.table(table).columns
    merged = merge(spark.table(table), incoming.select(*cols), key, order).select(*cols)
    merged.write.mode("overwrite").parquet(target)
    spark.sql(f"ALTER TABLE {table} SET LOCATION '{target}'")
    spark.catalog.refreshTable(table)
    return target


#: The hidden-away partition column of a bucketed target, and the property that says how many buckets it has.
BUCKET = "_bucket"
BUCKETS_PROPERTY = "merge-buckets"


def create_bucketed_target(spark: SparkSession, table: str, columns_ddl: str, location: str, buckets: int, comment: str | None = None) -> None:
    """A Parquet target whose rows lie in ``buckets`` partitions by the hash of their key, so that a merge rewrites the
    buckets it touches and no other.  About 256 MB a bucket is a good size; the number stays as it was created."""
    text = (comment or "").replace("\\", "\\\\").replace("'", "\\'")
    said = f" COMMENT '{text}'" if comment else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns_ddl}, {BUCKET} INT) USING parquet PARTITIONED BY ({BUCKET}){said} "
              f"LOCATION '{location.rstrip('/')}' TBLPROPERTIES ('{BUCKETS_PROPERTY}' = '{buckets}')")


def merge_buckets(spark: SparkSession, table: str, incoming: DataFrame, key: list[str], order: list[str]) -> list[int]:
    """Merge ``incoming`` into a bucketed target (C5); returns the buckets rewritten.

    The touched buckets are read, merged and written to a folder of this merge's own, and only then is each bucket's
    partition pointed at its part of it: until that moment readers see the old state, whatever dies.  A merge that dies
    between two buckets leaves each of them old or new as a whole, and running it again gives the same rows, since the
    newest row of a key wins either way.
    """
    buckets = int(table_property(spark, table, BUCKETS_PROPERTY))
    columns = [c for c in spark.table(table).columns if c != BUCKET]
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int").alias(BUCKET)
    batch = materialised(merge(None, incoming.select(*columns), key, order).select(*columns, bucket), "merge-batch")    # read twice
    touched = sorted(r[0] for r in batch.select(BUCKET).distinct().collect())             # at most one a bucket
    if not touched:
        return []
    current = spark.table(table).where(F.col(BUCKET).isin(*touched))
    folder = f"{table_location(spark, table).rstrip('/')}_merges/{uuid.uuid4().hex}"
    merge(current, batch, [*key, BUCKET], order).select(*columns, BUCKET).repartition(len(touched), BUCKET) \
        .write.partitionBy(BUCKET).parquet(folder)
    for b in touched:
        at = f"PARTITION ({BUCKET}={b})"
        spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {at} LOCATION '{folder}/{BUCKET}={b}'")
        spark.sql(f"ALTER TABLE {table} {at} SET LOCATION '{folder}/{BUCKET}={b}'")
    spark.catalog.refreshTable(table)
    return touched


def _provider(spark: SparkSession, table: str) -> str | None:
    for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect():
        if (r["col_name"] or "").strip() == "Provider":
            return (r["data_type"] or "").lower()
    return None


def _merge_into_iceberg(spark: SparkSession, table: str, incoming: DataFrame, key: list[str],
                        order: list[str]) -> str:
    """Iceberg targets: MERGE INTO from the batch, reduced first to one row per key."""
    source = merge(None, incoming, key, order)
    view = "_tidewater_merge_source"
    source.createOrReplaceTempView(view)
    on = " AND ".join(f"t.`{k}` = s.`{k}`" for k in key)
    newer = " OR ".join(f"s.`{c}` > t.`{c}`" for c in order)
    spark.sql(f"MERGE INTO {table} t USING {view} s ON {on} "
              f"WHEN MATCHED AND ({newer}) THEN UPDATE SET * WHEN NOT MATCHED THEN INSERT *")
    return table


def pull(landed: DataFrame, producer: str, watermark: dt.datetime, columns: list[layout.Column],
         pointer: str | None, merge_key: str) -> DataFrame:
    """S6 → C1 → C2 → C3/C6 → C4 for one producer."""
    docs = apply_pointer(explode_payload(incremental_pull(landed, producer, watermark)), pointer)
    return decode(docs, columns, merge_key)


def pull_many(landed: DataFrame, routes: list, watermark: dt.datetime, merge_key: str) -> DataFrame:
    """:func:`pull` for many producers in one pass over ``landed``: routes that share a layout and a
    pointer are decoded together, so the plan grows with distinct layouts and not with producers."""
    groups: dict[tuple, list] = {}
    for r in routes:
        groups.setdefault((tuple(r.columns), r.pointer), []).append(r.producer)
    past = explode_payload(landed.where(F.col("producer").isin(*[r.producer for r in routes])
                                        & (F.col("ts") > utc_literal(watermark))))
    if len(groups) == 1:
        (columns, pointer), _ = next(iter(groups.items()))
        return decode(apply_pointer(past, pointer), list(columns), merge_key)
    names = {tuple(c.name for c in columns) for columns, _ in groups}
    if len(names) > 1:
        raise ValueError("routes pulled together must have the same column names")
    parts = []
    for (columns, pointer), members in groups.items():
        parts.append(decode(apply_pointer(past.where(F.col("producer").isin(*members)), pointer), list(columns), merge_key))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def append_missing(spark: SparkSession, table: str, incoming: DataFrame, key: list[str], ts_col: str,
                   since: str | None = None) -> int:
    """Merge for keys whose rows never change (C5 on landing ids): insert the keys not present and
    return how many those were.

    A landing id is derived from the request, and a replayed request lands the same
    row again, so a merge on it only ever has to skip keys already in the target.
    Only the target's key column is read, and only for rows at or after ``since`` (the
    batch's earliest ``ts_col``; a copy can be no older), which Parquet statistics prune.
    """
    cols = spark.table(table).columns
    batch = merge(None, incoming.select(*cols), key, [ts_col])
    if since is None:
        since = batch.agg(F.min(ts_col)).first()[0]
        if since is None:
            return 0
    existing = spark.table(table).where(F.col(ts_col) >= F.lit(since)).select(*key)
    fresh = batch.join(existing, on=key, how="left_anti").select(*cols).persist(StorageLevel.DISK_ONLY_2)
    try:
        n = fresh.count()
        if n:
            # files sorted by time keep row-group min/max ranges tight for the next run's pruning
            fresh.sortWithinPartitions(ts_col).write.insertInto(table)
    finally:
        fresh.unpersist()
    return n


def position_log(spark: SparkSession, table: str) -> PositionLog:
    """The target's own log of how far it has read the landing table, beside its data."""
    base, _, tail = table_location(spark, table).rstrip("/").rpartition("/_v")
    return PositionLog(spark, f"{base if base and tail.isdigit() else table_location(spark, table).rstrip('/')}_positions")


def pull_into_table(spark: SparkSession, landed: DataFrame | str, table: str, producer: str,
                    columns: list[layout.Column], merge_key: str, version: int, insert_only: bool = True) -> dict:
    """One consumer run for one target table (C2-C7 end to end).

    A run reads what *landed* since the last one: the target's log holds the last batch read of each stream, so a row is
    pulled by the run after its batch was committed, however old its ``ts`` is, and once.  ``landed`` is the landing
    path, read through its manifest, or a frame with its columns.  The pointer comes from the table's
    ``json-pointer-expression`` property and the watermark from the table comment, both written at provisioning; the
    watermark is the newest landing time merged, and only reports (a table without a readable one is refused).  Rows
    are decoded and merged by the merge key before the position and then the watermark move, so a run that fails in
    between is repeated, and the keyed merge skips what it knows.

    Returns the table, ``read`` (landed rows of new batches), ``pulled`` (those past the watermark), ``inserted``
    (documents new to the table; None with ``insert_only=False``) and the watermark.
    """
    from tidewater.settings import POINTER_PROPERTY
    watermark = read_watermark(spark, table)
    pointer = table_property(spark, table, POINTER_PROPERTY)
    log = position_log(spark, table)
    position, _ = log.last()
    if isinstance(landed, str):
        rows, position = read_new(spark, landed, producer, position)
    else:
        landed = landed if "stream" in landed.columns else landed.withColumn("stream", F.lit(""))
        rows = landed.where((F.col("producer") == F.lit(producer)) & past(position))
        heads = {r["stream"]: r["head"] for r in rows.groupBy("stream").agg(F.max("batch_id").alias("head")).collect()}
        # what lands meanwhile is left to the next run
        rows = rows.where(~past({**position, **heads})) if heads else rows.limit(0)
        position = {**position, **heads}
    newer = F.col("ts") > utc_literal(watermark)
    seen = rows.agg(F.max(F.unix_micros("ts")).alias("newest"), F.min("timestampUTC").alias("since"),
                    F.count(F.lit(1)).alias("n"), F.count_if(newer).alias("past")).first()
    if not seen["n"]:
        return {"table": table, "read": 0, "pulled": 0, "inserted": 0, "watermark": watermark}
    newest = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=seen["newest"])
    docs = decode(apply_pointer(explode_payload(rows), pointer), columns, merge_key)
    ts_col = next(c.name for c in columns if c.name.lower() == TIMESTAMP_COLUMN.lower())
    key = next(c.name for c in columns if c.name.lower() == merge_key.lower())
    inserted = None
    if insert_only:
        text = next(c for c in columns if c.name == ts_col).type.lower() == "string"
        inserted = append_missing(spark, table, docs, [key], ts_col, seen["since"] if text else None)
    else:
        merge_into_table(spark, table, docs, [key], [ts_col], version)
    log.commit(position)
    if newest > watermark:
        advance_watermark(spark, table, newest)
    return {"table": table, "read": seen["n"], "pulled": seen["past"], "inserted": inserted, "watermark": max(newest, watermark)}
