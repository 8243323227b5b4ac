"""Engine settings (the Spark-side replacement of the service's layered config)."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values the landed data and the target tables must agree on.
DEFAULT_MAX_CONTENT_LENGTH = 400 * 1024          # bytes, strict ">" rejects
DEFAULT_BUFFER_CAPACITY = 10_000                  # newest records kept per producer (W1)
PUSH_EVENT_ID = "push_event_id"                   # the payload's own root "id" is landed under this name
TIMESTAMP_COLUMN = "timestampUTC"                 # envelope timestamp column
EPOCH_WATERMARK = '{"timestamp":"1970-01-01T00:00:00Z"}'
POINTER_PROPERTY = "json-pointer-expression"
COMMENT_PROPERTY = "comment"
FORMAT_VERSION_PROPERTY = "format-version"
VARIANT_FORMAT_VERSION = "3"
# Fixed-width UTC text for timestampUTC, so text order equals time order.
UTC_TEXT_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


@dataclass(frozen=True)
class Settings:
    api_version: str = "v1"
    max_content_length: int = DEFAULT_MAX_CONTENT_LENGTH
    merge_key: str = "merge_key"
    # Also hold the body's real bytes against the limit; by default the header is trusted.
    check_body_length: bool = False
    # Routes are broadcast to every task; above this many we fall back to a shuffle join.
    route_broadcast_limit: int = 100_000
    # ... and above this estimated size in bytes (programs and schemas ride on the rows).
    route_broadcast_bytes: int = 64 * 1024 * 1024
    # Salt buckets used by skew-safe per-producer operators.
    salt_buckets: int = 64
    table_format: str = "parquet"
