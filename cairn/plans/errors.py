"""Error codes.  Fixed values."""

from __future__ import annotations

CODES = {
    "cursor_invalid_token": 200,
    "cursor_incomplete_builder": 202,
    "load_limit_reached": 210,
    "load_invalid_primary_key": 211,
    "load_invalid_header": 212,
    "load_invalid_content": 213,
    "save_too_large": 214,
    "context_no_local_version": 220,
    "context_age_overflow": 221,
    "context_incarnation_set_twice": 222,
    "record_key_schema": 230,
    "record_key_mismatch": 231,
    "record_builder_limit": 232,
    "record_scan_corrupt": 233,
    "record_scan_state": 234,
    "descriptor_not_well_formed": 240,
    "message_not_admitted": 241,
    "value_not_convertible": 242,
    "schema_codec": 243,
    "primary_key_expression": 250,
    "index_expression": 251,
    "primary_key_schema": 260,
    "index_schema": 261,
    "uuid_length": 300,
}


class CairnError(Exception):
    """An error with a stable code."""

    def __init__(self, name: str, message: str = ""):
        self.name, self.code = name, CODES[name]
        super().__init__(f"{self.code} {name}: {message}" if message else f"{self.code} {name}")
