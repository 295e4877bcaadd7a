"""Structured logs: one JSON object per line, with the span it was written in and without signatures or credentials."""

from __future__ import annotations

import contextlib
import contextvars
import json
import logging
import os
import sys
import time
import uuid
from collections.abc import Iterator

# Names whose values are never written.
HIDDEN = frozenset(("authorization", "x-hub-signature", "x-hub-signature-256", "signature"))
_span: contextvars.ContextVar[dict | None] = contextvars.ContextVar("span", default=None)


def _clean(value):
    if isinstance(value, dict):
        return {k: "[redacted]" if str(k).lower() in HIDDEN else _clean(v) for k, v in value.items()}
    return [_clean(v) for v in value] if isinstance(value, (list, tuple)) else value


class _Lines(logging.Formatter):
    def __init__(self, service: str):
        super().__init__()
        self.service = service

    def format(self, record: logging.LogRecord) -> str:
        out = {"level": record.levelname.lower(), "time": time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(record.created)) + f".{int(record.msecs):03d}Z", "service": self.service}
        if span := _span.get():
            out |= {"trace_id": span["trace_id"], "span_id": span["span_id"]}
        out |= _clean(getattr(record, "fields", {}))
        if record.exc_info and record.exc_info[1]:
            out["error"] = f"{type(record.exc_info[1]).__name__}: {record.exc_info[1]}"
        return json.dumps(out | {"msg": record.getMessage()}, default=str)


def create_logger(service: str, stream=None) -> logging.Logger:
    """A logger of a service; the level comes from LOG_LEVEL. Fields go in as ``extra={"fields": {...}}``."""
    log = logging.getLogger(f"codeloom.{service}")
    log.handlers = [handler := logging.StreamHandler(stream or sys.stderr)]
    handler.setFormatter(_Lines(service))
    log.setLevel(os.environ.get("LOG_LEVEL", "info").upper())
    log.propagate = False
    return log


@contextlib.contextmanager
def span(name: str, log: logging.Logger, **attributes) -> Iterator[None]:
    """A named stretch of work: lines inside carry its ids, its end is logged with the time it took and how it ended."""
    above = _span.get()
    token = _span.set({"trace_id": above["trace_id"] if above else uuid.uuid4().hex, "span_id": uuid.uuid4().hex[:16]})
    began, status = time.monotonic(), "ok"
    try:
        yield
    except BaseException:
        status = "error"
        raise
    finally:
        log.info(name, extra={"fields": attributes | {"status": status, "duration_ms": round((time.monotonic() - began) * 1000, 1)}})
        _span.reset(token)
