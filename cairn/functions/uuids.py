"""UUIDs as 16 bytes and as text."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.plans.errors import CairnError


def to_bytes(text: Column) -> Column:
    """16 bytes of a canonical UUID; other text fails with code 300 when it is read."""
    data = F.unhex(F.replace(text, F.lit("-"), F.lit("")))
    return F.when(text.isNull(), F.lit(None).cast("binary")).when(F.octet_length(data) == 16, data).otherwise(F.raise_error(F.lit("300 uuid_length")).cast("binary"))


def to_text(data: Column) -> Column:
    h = F.lower(F.hex(data))
    text = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    return F.when(data.isNull(), F.lit(None).cast("string")).when(F.octet_length(data) == 16, text).otherwise(F.raise_error(F.lit("300 uuid_length")))


def check(data: bytes) -> uuid.UUID:
    if len(data) != 16:
        raise CairnError("uuid_length", str(len(data)))
    return uuid.UUID(bytes=bytes(data))
