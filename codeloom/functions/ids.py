"""Content addresses, stable JSON and deterministic ids, as columns and as plain Python."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: part of every parse-cache key; raise it when extraction output changes.
PARSER_VERSION = 2


def _ordered(value):
    if isinstance(value, dict):
        # keys by UTF-16 code units
        return {k: _ordered(value[k]) for k in sorted(value, key=lambda k: k.encode("utf-16-be"))}
    if isinstance(value, (list, tuple)):
        return [_ordered(v) for v in value]
    if isinstance(value, float) and value.is_integer():
        return int(value)
    return value


def stable_json(value) -> str:
    """JSON whose object keys are sorted at every level, so equal values give equal strings."""
    return json.dumps(_ordered(value), ensure_ascii=False, separators=(",", ":"))


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def hash_of(value, length: int = 16) -> str:
    return sha256_hex(stable_json(value))[:length]


def stable_json_column(fields: dict[str, Column]) -> Column:
    """The same for one row: a JSON object of the fields, sorted by name, nulls written out. Nested structs must have
    their fields in order already; integers only, since floating-point formats differ between engines."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def hash_column(json_column: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(json_column, 256), 1, length)


def blob_sha(content: Column) -> Column:
    """The id that git gives to a blob of this content (a string, taken as UTF-8, or binary)."""
    raw = content.cast("binary")
    head = F.concat(F.lit("blob ").cast("binary"), F.octet_length(raw).cast("string").cast("binary"), F.unhex(F.lit("00")))
    return F.sha1(F.concat(head, raw))


def parse_cache_key(language: Column, blob: Column, version: int = PARSER_VERSION) -> Column:
    return F.concat(F.lit(f"v{version}-"), language, F.lit("-"), blob)


def review_job_id(repository_id: Column, number: Column, head_sha: Column) -> Column:
    return F.concat_ws("-", F.lit("pr"), repository_id.cast("string"), number.cast("string"), head_sha)


def index_job_id(repository_id: Column, sha: Column) -> Column:
    return F.concat_ws("-", F.lit("index"), repository_id.cast("string"), sha)
