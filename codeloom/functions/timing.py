"""Backoff, quota clocks and signatures."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = "sha256="


def backoff_ms(attempt: Column, random: Column, retry_after_ms: Column | None = None, base_ms: int = 1_000, most_ms: int = 30_000) -> Column:
    """Full jitter below a ceiling that doubles with each attempt; a longer wait that the server asked for wins."""
    ceiling = F.least(F.lit(float(most_ms)), F.lit(float(base_ms)) * F.pow(F.lit(2.0), attempt - 1))
    own = F.floor(random * ceiling).cast("long")
    return own if retry_after_ms is None else F.greatest(F.coalesce(retry_after_ms.cast("long"), F.lit(0)), own)


def ms_until_midnight(utc: Column, zone: str = "America/Los_Angeles") -> Column:
    """Milliseconds until the day's quota starts anew in a time zone, by its wall clock; a minute at least."""
    local = F.from_utc_timestamp(utc, zone)
    seconds = F.hour(local) * 3600 + F.minute(local) * 60 + F.floor(F.second(local))
    return F.greatest(F.lit(60_000), 86_400_000 - seconds * 1000).cast("long")


def sign(secret: str, body: bytes) -> str:
    return PREFIX + hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()


def verify(secret: str, body: bytes | None, header: str | None) -> bool:
    """Whether the header is the signature of exactly these bytes. Compared in constant time."""
    if not secret or not header or not header.startswith(PREFIX):
        return False
    given = header[len(PREFIX) :]
    try:
        received = bytes.fromhex(given) if not any(c.isspace() for c in given) else b""
    except ValueError:
        return False
    return hmac.compare_digest(received, hmac.new(secret.encode(), body or b"", hashlib.sha256).digest())


def verified(secret: str, body: Column, header: Column) -> Column:
    """verify() over a binary and a string column, in Arrow batches: no built-in function computes an HMAC."""

    def check(bodies: pd.Series, headers: pd.Series) -> pd.Series:
        return pd.Series([verify(secret, b, h) for b, h in zip(bodies, headers, strict=True)], dtype="bool")

    check.__annotations__ = {"bodies": pd.Series, "headers": pd.Series, "return": pd.Series}
    return F.pandas_udf(check, "boolean")(body, header)
