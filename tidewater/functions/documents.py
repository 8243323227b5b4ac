"""Per-row document functions: JSON media type, root-id rename, envelope stamp, client address."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.settings import PUSH_EVENT_ID, UTC_TEXT_FORMAT


def is_json_media_type(content_type: Column) -> Column:
    """Main type application, subtype json, case-insensitive, parameters allowed (F2)."""
    main = F.lower(F.trim(F.split(content_type, ";", 2).getItem(0)))
    return F.coalesce(main == "application/json", F.lit(False))


# One string of a JSON text after the other: what lies outside strings before it moves the depth, and a string at depth 1
# that a colon follows is a member's name.  Escapes are blanked out first, two characters for two, so every quote left is
# a string's edge and places stay what they are in the text.
_COUNT = "length({0}) - length(translate({0}, '{1}', ''))"
_SCAN = rf"""aggregate(
  CASE WHEN size(s0.parts) > 2 THEN sequence(0, size(s0.parts) - 3, 2) ELSE cast(array() AS array<int>) END,
  named_struct('depth', 0, 'seen', 0, 'at', 0, 'found', -1, 'width', 0),
  (a0, i0) -> transform(array(named_struct(
      'depth', a0.depth + {_COUNT.format('s0.parts[i0]', '{[')} - ({_COUNT.format('s0.parts[i0]', '}]')}),
      'start', a0.at + length(s0.parts[i0]) + 1, 'width', length(s0.parts[i0 + 1]))), t0 -> transform(array(
        a0.seen + CASE WHEN t0.depth = 1 AND s0.parts[i0 + 2] RLIKE r'^[ \t\n\r]*:' THEN 1 ELSE 0 END), n0 -> named_struct(
      'depth', t0.depth, 'seen', n0, 'at', t0.start + t0.width + 1,
      'found', CASE WHEN n0 = s0.nth AND a0.seen < n0 THEN t0.start ELSE a0.found END,
      'width', CASE WHEN n0 = s0.nth AND a0.seen < n0 THEN t0.width ELSE a0.width END))[0])[0])"""
_FIRST = r"^[ \t\n\r]*\{[ \t\n\r]*"              # before the first member: most documents begin with their id
_RENAME = rf"""r0 -> CASE WHEN array_contains(json_object_keys(r0.body), 'id') AND NOT array_contains(json_object_keys(r0.body), '{PUSH_EVENT_ID}')
    AND try_cast(r0.v AS map<string,variant>) IS NOT NULL
    AND size(try_cast(try_parse_json(concat('[', r0.body, ']')) AS array<variant>)) = 1
  THEN CASE WHEN r0.body RLIKE r'{_FIRST}"id"[ \t\n\r]*:' THEN regexp_replace(r0.body, r'({_FIRST})"id"', '$1"{PUSH_EVENT_ID}"')
    ELSE transform(array(named_struct('parts', split(regexp_replace(r0.body, r'(?s)\\.', '__'), '"'),
                                    'nth', cast(array_position(json_object_keys(r0.body), 'id') AS int))),
    s0 -> transform(array({_SCAN}), f0 -> CASE WHEN f0.found < 0 THEN r0.body ELSE concat(
      left(r0.body, f0.found - 1), '"{PUSH_EVENT_ID}"', substring(r0.body, f0.found + f0.width + 2)) END)[0])[0] END
  ELSE r0.body END"""


def rename_root_id(body: Column, v: Column) -> Column:
    """Object root with "id" and without "push_event_id": rename that member (P3), every other character as it was sent.

    ``v`` is the body parsed once (NULL for invalid JSON or duplicate keys).  The whole text must be one object: parsing
    alone would ignore what follows the first document.  Anything else is returned untouched.
    """
    renamed = F.call_function("transform", F.array(F.struct(body.alias("body"), v.alias("v"))), F.expr(_RENAME))
    return F.coalesce(renamed.getItem(0), body)


def utc_text(ts: Column) -> Column:
    """Fixed-width ISO-8601 UTC text: string order equals time order (session time zone is UTC)."""
    return F.date_format(ts, UTC_TEXT_FORMAT)


def landing_id(request_id: Column, producer: Column) -> Column:
    """Deterministic record id (UUID-shaped), stable across task retries and batch replays."""
    h = F.sha2(F.concat_ws("|", producer, request_id), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def client_ip(x_forwarded_for: Column, x_real_ip: Column, remote_addr: Column) -> Column:
    """First X-Forwarded-For entry (trimmed) → X-Real-IP → remote address → "unknown" (P8)."""
    first = F.trim(F.split(x_forwarded_for, ",", 2).getItem(0))
    return F.coalesce(first, x_real_ip, remote_addr, F.lit("unknown"))


def correlation_id(x_correlation_id: Column, request_id: Column) -> Column:
    """Header value, else an id derived from the request."""
    return F.coalesce(x_correlation_id, request_id)
