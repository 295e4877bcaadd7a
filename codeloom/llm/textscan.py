"""Vectorised scanning of text columns that arrive as Arrow batches.

The kernels here read the UTF-8 bytes of a whole batch at once and never build a Python string
per word: word borders come from a byte table, word hashes from a segmented sum, hashes of longer
windows from pairs of shorter ones. Multi-byte characters need no decoding, since every word
class used by the operators treats all bytes from 0x80 on alike.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step works on; a longer document is a step of its own.
STEP_BYTES = 2 << 20

_ALL = np.arange(256)
#: Bytes of words that are separated by ASCII white space: ``[^\x20\x09-\x0D]+``.
NOT_SPACE = ~((_ALL == 0x20) | ((_ALL >= 0x09) & (_ALL <= 0x0D)))
#: Bytes of words of ASCII letters, digits and everything above ASCII.
WORD_CHAR = (_ALL >= 0x80) | ((_ALL >= 0x30) & (_ALL <= 0x39)) | ((_ALL >= 0x41) & (_ALL <= 0x5A)) | ((_ALL >= 0x61) & (_ALL <= 0x7A))
#: Lower-cases A-Z and leaves all other bytes.
LOWER = np.where((_ALL >= 0x41) & (_ALL <= 0x5A), _ALL + 32, _ALL).astype(np.uint8)
SAME = _ALL.astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection on 64 bits whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def keys(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit keys."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


class Step(NamedTuple):
    """Some whole documents of a batch."""

    first: int  #: row of the first document in the batch
    n: int  #: documents
    data: np.ndarray  #: their bytes
    edges: np.ndarray  #: n + 1 byte offsets into data


class Words(NamedTuple):
    starts: np.ndarray  #: byte offset of each word in the step
    ends: np.ndarray
    doc: np.ndarray  #: the document (0 to n-1) of each word
    counts: np.ndarray  #: words of each document
    firsts: np.ndarray  #: n + 1 word offsets


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; nulls read as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data, offsets


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives freed memory back to the system: idle Python workers would keep what their largest batch took."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def steps(column: pa.Array, most: int = STEP_BYTES) -> Iterator[Step]:
    """Cuts a column into runs of whole documents of about ``most`` bytes. After a large one memory is released."""
    n = len(column)
    if n == 0:
        return
    data, offsets = column_bytes(column)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(n, max(at + 1, to))
        low, high = int(offsets[at]), int(offsets[to])
        yield Step(at, to - at, data[low:high], offsets[at : to + 1] - low)
        at = to
    if offsets[n] - offsets[0] > 2 * STEP_BYTES:
        release()


def words(step: Step, inside: np.ndarray) -> Words:
    """Maximal runs of bytes of the class ``inside`` within each document."""
    data, edges = step.data, step.edges
    size = len(data)
    if size == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(step.n, np.int64), np.zeros(step.n + 1, np.int64))
    body = inside[data]
    before = np.empty(size, bool)
    before[0] = False
    before[1:] = body[:-1]
    after = np.empty(size, bool)
    after[-1] = False
    after[:-1] = body[1:]
    cuts = edges[1:-1]
    before[cuts[cuts < size]] = False
    after[cuts[cuts > 0] - 1] = False
    starts = np.flatnonzero(body & ~before)
    ends = np.flatnonzero(body & ~after) + 1
    firsts = np.searchsorted(starts, edges)
    counts = np.diff(firsts)
    return Words(starts, ends, np.repeat(np.arange(step.n), counts), counts, firsts)


_BYTE = {seed: keys(256, seed) for seed in (1, 2)}
_PLACE = {seed: keys(1024, 100 + seed) | np.uint64(1) for seed in (1, 2)}


def word_hashes(step: Step, found: Words, fold: np.ndarray = SAME, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each word's bytes after ``fold``; equal words have equal hashes in every batch."""
    if len(found.starts) == 0:
        return np.zeros(0, np.uint64)
    lengths = found.ends - found.starts
    low, high = int(found.starts[0]), int(found.ends[-1])
    starts, ends = (found.starts - low).astype(np.int32), (found.ends - low).astype(np.int32)
    # each byte counts by its place after the last word's start; sums over words are differences of sums from the beginning
    place = np.arange(high - low, dtype=np.int32)
    place -= np.repeat(starts, np.diff(starts, append=np.int32(high - low)))
    table = _PLACE[seed]
    if (longest := int(lengths.max())) > len(table):
        table = keys(longest, 100 + seed) | np.uint64(1)
    values = _BYTE[seed][fold][step.data[low:high]]
    values *= np.take(table, place, mode="clip")
    np.cumsum(values, out=values)
    sums = values[ends - 1]
    sums[1:] -= values[starts[1:] - 1]
    return mix(sums + lengths.astype(np.uint64))


def grouped(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal hashes stand together, and where in it each group starts. Sorting numbers with their places in
    the lowest bits is several times faster than sorting places; a group may come in parts if another hash has its highest
    bits, with a chance of one in billions per pair."""
    low = np.uint64((1 << max(1, len(hashes).bit_length())) - 1)
    packed = hashes & ~low
    packed |= np.arange(len(hashes), dtype=np.uint64)
    packed.sort()
    order = (packed & low).astype(np.int64)
    ordered = hashes[order]
    return order, np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(hashes)])


_LEFT, _RIGHT = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of two neighbouring (or overlapping) windows taken as one."""
    return mix(left * _LEFT + (right ^ (right >> np.uint64(29))) * _RIGHT)


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of ``length`` items, by doubling; window i starts at item i. Ignores document borders."""
    have, at = 1, hashes
    if len(hashes) < length:
        return np.zeros(0, np.uint64)
    while have < length:
        add = min(have, length - have)
        at = pair(at[:-add], at[add:]) if add else at
        have += add
    return at


def inside_documents(found: Words, length: int) -> np.ndarray:
    """Whether the window of ``length`` words that starts at each word (but for the last length - 1) stays in its document."""
    n = len(found.doc) - length + 1
    return found.doc[:n] == found.doc[length - 1 :] if n > 0 else np.zeros(0, bool)

