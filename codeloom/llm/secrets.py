"""Finds secrets in texts: strong patterns by themselves, weak ones where the parts of a credential stand together."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

# The strong patterns and the least lengths of what they find.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN = 6

#: Weak parts: identifiers in capitals and digits, long mixed tokens, and places to connect to.
WEAK_ID = re.compile(r"(?<![A-Za-z0-9])(?=[A-Z]*[0-9])(?=[0-9]*[A-Z])[A-Z0-9]{12,}+(?![A-Za-z0-9])")
WEAK_KEY = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"(?<![a-z0-9+])[a-z][a-z0-9+]*+://[A-Za-z0-9._~:@%-]+|(?<![A-Za-z0-9.-])(?:[a-z0-9-]++\.){2,}+[a-z0-9-]*:[0-9]{2,5}(?![0-9])")
BREAK = re.compile(r"\n[\x20\t\r]*\n")
#: Order of kinds that start at the same place.
KINDS = ("assign", "access", "hex", "id", "key", "endpoint")
#: Default of the greatest distance, in code points, between the parts of a credential; None for a whole scope.
REACH = 400


def strong_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the patterns that need no company."""
    out = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return out


def entropy(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def _mixed(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.isupper() for c in token) and any(c.islower() for c in token) and entropy(token) >= 3.5


class Intervals:
    """Intervals of one sort in one text, for joins by scope and distance. Of intervals sorted by start, those that end
    after a point are found through the running maximum of ends."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans = sorted(spans)
        self.starts = [s for s, _ in self.spans]
        self.ends, most = [], -1
        for _, e in self.spans:
            most = max(most, e)
            self.ends.append(most)

    def meets(self, low: int, high: int) -> bool:
        """Whether any interval starts before ``high`` and ends after ``low``."""
        before = bisect_right(self.starts, high)
        return before > 0 and self.ends[before - 1] >= low


def linked_spans(text: str, strong: list[tuple[int, str, int]], reach: int | None = REACH) -> list[tuple[int, str, int]]:
    """Weak identifiers, keys and endpoints that complete a credential.

    A scope is a run of lines without a blank one. An identifier and a secret (strong ones included) are complementary
    within one scope at ``reach`` code points or less, or anywhere in it if that is None; an endpoint joins where both stand
    in its reach. Identifiers have 12 letters and digits or more, keys 20 or more, endpoints any length. Each candidate is
    tested by a search in the sorted intervals of the other sort: pairs are not formed.
    """
    taken = Intervals([(s, e - 1) for s, _, e in strong])
    free = lambda found: [(m.start(), m.end()) for m in found if not taken.meets(m.start(), m.end() - 1)]
    ids = free(WEAK_ID.finditer(text))
    weak = [(s, e) for s, e in free(WEAK_KEY.finditer(text)) if _mixed(text[s:e])]
    strong_ids = [(s, e) for s, k, e in strong if k == "access"]
    strong_keys = [(s, e) for s, k, e in strong if k != "access"]
    if not (ids and (weak or strong_keys)) and not (weak and strong_ids) and not (strong_ids and strong_keys):
        return []
    breaks = [(m.start(), m.end()) for m in BREAK.finditer(text)]
    first = [s for s, _ in breaks]

    def bounds(s: int, e: int) -> tuple[int, int]:
        at = bisect_left(first, s)
        low, high = breaks[at - 1][1] if at else 0, first[at] if at < len(breaks) else len(text)
        return (low, high) if reach is None else (max(low, s - reach), min(high, e + reach))

    all_ids, all_keys = Intervals(strong_ids + ids), Intervals(strong_keys + weak)
    out = [(s, "id", e) for s, e in ids if all_keys.meets(*bounds(s, e))]
    out += [(s, "key", e) for s, e in weak if all_ids.meets(*bounds(s, e))]
    found = [(s, e) for s, e in free(ENDPOINT.finditer(text))]
    out += [(s, "endpoint", e) for s, e in found if all_ids.meets(*bounds(s, e)) and all_keys.meets(*bounds(s, e))]
    return out


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in sorted(spans, key=lambda x: (x[0], KINDS.index(x[1]), x[2])))


def scan_text(text: str | None, reach: int | None = REACH) -> tuple[int, int, int, str, str]:
    text = text or ""
    strong = strong_spans(text)
    kinds = [k for _, k, _ in strong]
    everything = strong + linked_spans(text, strong, reach)
    return kinds.count("assign"), kinds.count("access"), kinds.count("hex"), joined(strong), joined(everything)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int | None = REACH) -> DataFrame:
    """Per document (id, n_assign, n_access, n_hex, base, spans): ``base`` lists the spans of the strong patterns as
    kind:start:end, ``spans`` adds the weak parts that are linked. Positions are code points, ends exclusive. Null texts
    are empty. Parts are linked within ``reach`` code points of a scope, or its whole (None). Rows are independent: repeats
    get equal results, and no row leaves its task."""
    docs = pick(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [scan_text(t, reach) for t in part.column(1).to_pylist()]
                columns = list(zip(*found, strict=True)) if found else [()] * 5
                types = [pa.int64()] * 3 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["id", "n_assign", "n_access", "n_hex", "base", "spans"])

    found = docs.mapInArrow(run, "id long, n_assign long, n_access long, n_hex long, base string, spans string")
    return found.withColumnRenamed("id", id_col)

