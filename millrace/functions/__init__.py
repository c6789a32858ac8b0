from .lsn import lsn_diff, lsn_order, lsn_parse, lsn_text
from .names import (auth_result, breaker_label, channel_table, channel_text,
                    valid_name, valid_request_id)
from .jsontext import json_embed, json_float, json_object, json_quote
from .pgtypes import (json_literal, json_literal_of, pg_array_json, pg_bool, pg_bytea_b64,
                      pg_interval_iso, pg_timestamp_iso, pg_timestamptz_iso)
from .times import rfc3339_utc

__all__ = [
    "auth_result", "breaker_label", "channel_table", "channel_text", "json_embed",
    "json_float", "json_literal", "json_literal_of", "json_object", "json_quote", "lsn_diff", "lsn_order", "lsn_parse",
    "lsn_text", "pg_array_json", "pg_bool", "pg_bytea_b64", "pg_interval_iso",
    "pg_timestamp_iso", "pg_timestamptz_iso", "rfc3339_utc", "valid_name",
    "valid_request_id",
]
