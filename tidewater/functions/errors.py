"""Gate outcome codes → HTTP-like status and message text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACCEPTED = 202

# Fixed values: (error_code, status, message template).  Templates use the
# placeholders {producer}, {length}, {max}, {pointer}, {cause}.
ERROR_CODES = [
    ("serialization", 400, "Invalid payload: {cause}"),
    ("schema_validation", 400, "Schema validation failed: {cause}"),
    ("connection", 500, "Persistence connection error: {cause}"),
    ("data_write", 500, "Persistence write error: {cause}"),
    ("too_large", 413, "Payload too large: {length} bytes (max {max})"),
    ("length_required", 411, "Content-Length header is required"),
    ("no_content", 400, "Request body is required"),
    ("content_encoding", 400, "{cause}"),
    ("content_type", 415, "Only application/json is accepted"),
    ("access_denied", 403, ""),
    ("parse", 400, "Parse error"),
    ("invalid_json_path", 400, "application error: invalid json path for payload: '{pointer}'"),
    ("unrouted", 404, ""),
    ("invalid_route", 500, "Route configuration error: {cause}"),
]
STATUS = {code: status for code, status, _ in ERROR_CODES}
TEMPLATE = {code: tmpl for code, _, tmpl in ERROR_CODES}
ACCEPT_TEMPLATE = "accepted for {producer}: {bytes} bytes"


def status_col(error_code: Column) -> Column:
    expr = F.when(error_code.isNull(), F.lit(ACCEPTED))
    for code, status, _ in ERROR_CODES:
        expr = expr.when(error_code == code, F.lit(status))
    return expr.otherwise(F.lit(500))


def _render(template: str, values: dict[str, Column]) -> Column:
    parts: list[Column] = []
    rest = template
    while rest:
        start = rest.find("{")
        if start < 0:
            parts.append(F.lit(rest))
            break
        end = rest.index("}", start)
        if start:
            parts.append(F.lit(rest[:start]))
        parts.append(F.coalesce(values[rest[start + 1:end]].cast("string"), F.lit("")))
        rest = rest[end + 1:]
    return F.concat(*parts) if parts else F.lit("")


def message_col(error_code: Column, values: dict[str, Column]) -> Column:
    """Response text for each outcome; ``values`` supplies the template placeholders."""
    expr = F.when(error_code.isNull(), _render(ACCEPT_TEMPLATE, values))
    for code, _, tmpl in ERROR_CODES:
        if "{" in tmpl:
            expr = expr.when(error_code == code, _render(tmpl, values))
        else:
            expr = expr.when(error_code == code, F.lit(tmpl))
    return expr
