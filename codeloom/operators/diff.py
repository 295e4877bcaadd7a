"""Unified diffs: a scanner for texts, and the flat tables that other operators join to."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, pairwise

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HUNK = "struct<old_start:int,old_lines:int,new_start:int,new_lines:int,lines:array<struct<type:string,content:string,old_line:int,new_line:int>>>"
FILE = f"struct<old_path:string,new_path:string,status:string,binary:boolean,hunks:array<{HUNK}>>"

# The words of the format.
BORDER = "diff --git "
RANGE = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", re.ASCII)
PATH = r'(\S+|"(?:[^"\\]|\\.)*")'
PATHS = re.compile(f"{BORDER}{PATH} {PATH}$")
NOTE = re.compile(r"(?P<added>new file mode)|(?P<deleted>deleted file mode)|(?P<binary>Binary files |GIT binary patch$)|rename from (?P<renamed_old>.*)|rename to (?P<renamed_new>.*)|--- (?P<old>.*)|\+\+\+ (?P<new>.*)", re.DOTALL)
#: First characters of lines in a hunk: what they are, and whether the old and the new side have them.
KINDS = {" ": ("context", 1, 1), "": ("context", 1, 1), "-": ("del", 1, 0), "+": ("add", 0, 1)}


def clean_path(raw: str) -> str | None:
    """A path as a header gives it, without quotes, escapes of ``"`` and ``\\`` and the side's prefix; null for no file."""
    raw = raw.strip()
    if raw == "/dev/null":
        return None
    if len(raw) >= 2 and raw[0] == raw[-1] == '"':
        raw = re.sub(r'\\(["\\])', r"\1", raw[1:-1])
    return raw.removeprefix(raw[:2]) if raw[:2] in ("a/", "b/") else raw


def _blocks(lines: list[str], starts: list[int]) -> list[list[str]]:
    return [lines[a:b] for a, b in pairwise([*starts, len(lines)])]


def _hunk(block: list[str]) -> tuple[dict, list[str]]:
    """The hunk at the head of a block, and the lines that are not of it.

    Each side has a prefix sum of the lines before it. A line is the hunk's as long as the sum of either side is short of
    the header's count, and its number is the side's start plus the sum: ``--- x`` is a removed line where one is due.
    """
    first, *body = block
    old, n_old, new, n_new = (1 if n is None else int(n) for n in RANGE.match(first).groups())
    kinds = [KINDS.get(line[:1], (None, 0, 0)) for line in body]
    sums = zip(accumulate((k[1] for k in kinds), initial=0), accumulate((k[2] for k in kinds), initial=0), strict=True)
    lines, other = [], []
    for text, (kind, on_old, on_new), (i, j) in zip(body, kinds, sums, strict=False):
        if kind and (i < n_old or j < n_new):
            lines.append({"type": kind, "content": text[1:], "old_line": old + i if on_old else None, "new_line": new + j if on_new else None})
        else:
            other.append(text)
    return {"old_start": old, "old_lines": n_old, "new_start": new, "new_lines": n_new, "lines": lines}, other


def _file(block: list[str]) -> dict:
    """A file from the lines between two borders; what is outside of hunks says what became of it."""
    named = PATHS.match(block[0])
    heads = [i for i, line in enumerate(block) if RANGE.match(line)]
    read = [_hunk(b) for b in _blocks(block, heads)]
    outside = block[1 : heads[0]] if heads else block[1:]
    paths = dict(zip(("old", "new"), (clean_path(x) for x in named.groups()) if named else (None, None), strict=True))
    status, binary = "modified", False
    for m in filter(None, map(NOTE.match, [*outside, *(x for _, other in read for x in other)])):
        word, _, side = m.lastgroup.partition("_")
        binary |= word == "binary"
        if word in ("added", "deleted", "renamed"):
            status = word
        if (side or word) in paths:
            paths[side or word] = clean_path(m[m.lastgroup])
    gone = {"added": "old", "deleted": "new"}.get(status)
    old, new = (None if side == gone else path for side, path in paths.items())
    return {"old_path": old, "new_path": new, "status": status, "binary": binary, "hunks": [hunk for hunk, _ in read]}


def parse(text: str | None) -> list[dict]:
    """The files of a unified diff, with hunks and numbered lines. Null and text without borders have none.

    Lines cannot be told from borders and headers of hunks by accident, since lines of a hunk start with a mark or are
    empty; so a text is cut at borders, files are cut at headers, and each piece is read by itself."""
    lines = re.split(r"\r?\n", text or "")
    return [_file(b) for b in _blocks(lines, [i for i, line in enumerate(lines) if line.startswith(BORDER)])]


def diff_files(changes: DataFrame, diff_col: str = "diff", keys: tuple[str, ...] = ("review_id",)) -> DataFrame:
    """A row per file of each change: (keys, file_seq, old_path, new_path, status, binary, hunks).

    The scanner keeps state from line to line, so it is a Python pass over each text; texts are independent and stay where
    they are read."""

    def scan(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([parse(t) for t in texts])

    scan.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    parsed = changes.select(*keys, F.posexplode(F.pandas_udf(scan, f"array<{FILE}>")(F.col(diff_col))).alias("file_seq", "file"))
    return parsed.select(*keys, "file_seq", "file.*")


def diff_lines(files: DataFrame, keys: tuple[str, ...] = ("review_id",)) -> DataFrame:
    """A row per diff line: (keys, file_seq, old_path, new_path, status, binary, hunk_seq, old_start, ..., line_seq, type,
    content, old_line, new_line)."""
    hunks = files.select(*keys, "file_seq", "old_path", "new_path", "status", "binary", F.posexplode("hunks").alias("hunk_seq", "hunk"))
    flat = hunks.select(*keys, "file_seq", "old_path", "new_path", "status", "binary", "hunk_seq", "hunk.old_start", "hunk.old_lines", "hunk.new_start", "hunk.new_lines", F.posexplode("hunk.lines").alias("line_seq", "line"))
    return flat.select(*[c for c in flat.columns if c != "line"], "line.*")


def first_added(lines: DataFrame, keys: tuple[str, ...] = ("review_id",)) -> DataFrame:
    """The first added line of each change, as (keys, path, line)."""
    place = F.struct("file_seq", "hunk_seq", "line_seq")
    added = lines.filter((F.col("type") == "add") & ~F.col("binary") & F.col("new_path").isNotNull())
    return added.groupBy(*keys).agg(F.min_by("new_path", place).alias("path"), F.min_by("new_line", place).alias("line"))
