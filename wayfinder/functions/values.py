"""Scalar kinds, coercion, timestamp texts and literal texts."""

from __future__ import annotations

import base64
import json
import re
from datetime import datetime, timedelta, timezone

from ..errors import QueryError

_STAMP = re.compile(r"(\d{4})-(\d\d)-(\d\d)(?:([T ])(\d\d):(\d\d):(\d\d)(?:\.(\d+))?(Z|[+-]\d\d:\d\d)?)?")


def parse_timestamp(text: str) -> datetime:
    """A naive UTC time, to microseconds; a text without a zone is UTC."""
    m = _STAMP.fullmatch(text)
    if not m:
        raise QueryError(f"invalid timestamp {text!r}")
    y, mo, d, _, h, mi, s, frac, zone = m.groups()
    try:
        t = datetime(int(y), int(mo), int(d), int(h or 0), int(mi or 0), int(s or 0), int((frac or "0")[:6].ljust(6, "0")))
    except ValueError as e:
        raise QueryError(f"invalid timestamp {text!r}") from e
    if zone and zone != "Z":
        t -= timedelta(hours=int(zone[1:3]), minutes=int(zone[4:])) * (1 if zone[0] == "+" else -1)
    return t


def kind_of(v: object) -> str:
    if v is None:
        return "null"
    for kind, types in (("bool", bool), ("int", int), ("float", float), ("string", str), ("bytes", (bytes, bytearray)), ("timestamp", datetime)):
        if isinstance(v, types):
            return kind
    raise QueryError(f"unsupported value {v!r}")


def coerce(v: object, type_: str) -> object:
    """The value as a column of this type takes it."""
    kind = kind_of(v)
    if kind in (type_, "null"):
        return v.astimezone(timezone.utc).replace(tzinfo=None) if kind == "timestamp" and v.tzinfo else v
    if kind == "int" and type_ == "float":
        return float(v)
    if kind == "string" and type_ == "timestamp":
        return parse_timestamp(v)
    raise QueryError(f"cannot use {kind} as {type_}")


def can_coerce(v: object, type_: str) -> bool:
    try:
        coerce(v, type_)
    except QueryError:
        return False
    return True


def comparable(a: str, b: str) -> bool:
    return "null" in (a, b) or a == b or {a, b} in ({"int", "float"}, {"string", "timestamp"})


def literal_text(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        return json.dumps(v, ensure_ascii=False)
    if isinstance(v, float):
        return f"{v:.15g}"
    if isinstance(v, datetime):
        return v.isoformat() + "Z"
    if isinstance(v, (bytes, bytearray)):
        return "0x" + bytes(v).hex()
    return str(v)


def json_value(v: object) -> object:
    """For GraphQL results: NaN and infinities as null, bytes as base64, times as RFC 3339."""
    if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))):
        return None
    if isinstance(v, (bytes, bytearray)):
        return base64.b64encode(bytes(v)).decode()
    if isinstance(v, datetime):
        text = v.strftime("%Y-%m-%dT%H:%M:%S") + (f".{v.microsecond:06d}".rstrip("0") if v.microsecond else "")
        return text + "Z"
    return v
