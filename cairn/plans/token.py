"""Continuation tokens: where a scan stopped, as opaque bytes."""

from __future__ import annotations

import base64
import datetime
import decimal
import json
from dataclasses import dataclass, field

from cairn.plans.errors import CairnError

VERSION = 1
BEGIN, KEY, END = "begin", "key", "end"


def _out(v):
    if isinstance(v, (bytes, bytearray)):
        return {"b": base64.b64encode(bytes(v)).decode()}
    if isinstance(v, datetime.datetime):
        return {"t": v.isoformat()}
    if isinstance(v, datetime.date):
        return {"d": v.isoformat()}
    if isinstance(v, decimal.Decimal):
        return {"n": str(v)}
    if v is None or isinstance(v, (bool, int, float, str)):
        return v
    raise CairnError("cursor_invalid_token", f"{type(v).__name__} can't be part of a key")


def _in(v):
    if isinstance(v, dict):
        (kind, x), *more = v.items()
        if more:
            raise ValueError("odd key part")
        return {"b": base64.b64decode, "t": datetime.datetime.fromisoformat, "d": datetime.date.fromisoformat, "n": decimal.Decimal}[kind](x)
    return v


@dataclass(frozen=True)
class Continuation:
    """The begin marker, the last key that was returned, or the end marker."""

    kind: str = BEGIN
    key: tuple = field(default=())

    @staticmethod
    def begin() -> Continuation:
        return Continuation(BEGIN)

    @staticmethod
    def at(*key) -> Continuation:
        return Continuation(KEY, tuple(key))

    @staticmethod
    def end() -> Continuation:
        return Continuation(END)

    def is_begin_marker(self) -> bool:
        return self.kind == BEGIN

    def is_end_marker(self) -> bool:
        return self.kind == END

    def to_bytes(self) -> bytes:
        return base64.urlsafe_b64encode(json.dumps({"v": VERSION, "kind": self.kind, "key": [_out(v) for v in self.key]}).encode())

    @staticmethod
    def from_bytes(data: bytes) -> Continuation:
        """Anything but a token of this version is an error 200."""
        try:
            x = json.loads(base64.b64decode(data, altchars=b"-_", validate=True))
            if x["v"] != VERSION or x["kind"] not in (BEGIN, KEY, END) or (x["kind"] == KEY) != bool(x["key"]):
                raise ValueError("another version or an odd marker")
            return Continuation(x["kind"], tuple(_in(v) for v in x["key"]))
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            raise CairnError("cursor_invalid_token", str(e)) from None
