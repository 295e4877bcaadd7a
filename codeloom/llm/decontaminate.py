"""Finds benchmark passages in training text with suffix arrays over the training words."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, map_rows, once, pick, with_row_key
from .textscan import LOWER, WORD_CHAR, Step, pair, steps, word_hashes, words

#: Bytes of benchmark text that one broadcast holds, or a single item if that is longer; more are searched block by block.
BLOCK_BYTES = 4_000_000
#: Bytes of training text, in whole documents, that one suffix array covers. A task takes about 40 times as much memory for it.
SHARD = 2 << 20
MATCH = "array<struct<at:int,words:int,item:string>>"
SCHEMA = f"__key long, __id long, n_words long, hits array<int>, items array<string>, matches {MATCH}"


class Windows(NamedTuple):
    """The distinct windows of one length."""

    size: int
    keys: np.ndarray  #: words of each
    low: np.ndarray  #: of each the first and the end position in starts
    high: np.ndarray
    starts: np.ndarray
    of_head: np.ndarray  #: the windows of head h are those from of_head[h] to of_head[h + 1]


class Tests:
    """A block of benchmark items, as word hashes with the items' borders.

    All suffixes of all items are the search strings. ``head`` words at the start of a training suffix must be the start
    of some test window for the suffix to be worth a place in the array.
    """

    def __init__(self, ids: list, texts: list, window: int):
        self.ids = [None if x is None else str(x) for x in ids]
        column = pa.array([t or "" for t in texts], pa.large_string())
        hashes, item = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for step in steps(column):
            found = words(step, WORD_CHAR)
            hashes.append(word_hashes(step, found, LOWER))
            item.append(found.doc + step.first)
        self.words, self.item = np.concatenate(hashes), np.concatenate(item)
        self.counts = np.bincount(self.item, minlength=len(self.ids))
        ends = np.cumsum(self.counts)
        left = ends[self.item] - np.arange(len(self.item))  # words from here to the item's end
        # a window starts at each word with `window` words left, or at the first word of a shorter item
        size = np.minimum(self.counts[self.item], window)
        self.starts = np.flatnonzero(left >= size)
        self.sizes = size[self.starts]
        self.window = window
        self.head = int(min(3, self.sizes.min())) if len(self.sizes) else 1
        self.heads = np.unique(_span(self.words, self.starts, self.head))
        # each distinct window once, by its head: its words, and where in ``starts`` the places are at which it stands
        self.by_size = []
        for n in np.unique(self.sizes):
            mine = self.starts[self.sizes == n]
            rows = _rows(self.words, mine, int(n))
            order = np.lexsort(rows.T[::-1])
            rows, starts = rows[order], mine[order]
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
            low = np.flatnonzero(new)
            high = np.append(low[1:], len(rows))
            head = np.searchsorted(self.heads, _span(self.words, starts[low], self.head))
            by = np.argsort(head, kind="stable")
            self.by_size.append(Windows(int(n), rows[low[by]], low[by], high[by], starts, np.searchsorted(head[by], np.arange(len(self.heads) + 1))))


def _span(hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """One hash of the n words at each start; starts must have n words left."""
    out = hashes[starts]
    for i in range(1, n):
        out = pair(out, hashes[starts + i])
    return out


def _rows(hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    return hashes[starts[:, None] + np.arange(n)]


def suffix_array(hashes: np.ndarray, ends: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Sorts the suffixes that start at ``at`` by their first ``depth`` words (0 past the end of a document), in the order
    of the word hashes. Rows of the result are those words; sorting is by columns, last first, so it is a radix sort."""
    columns = [np.where(at + i < ends, hashes[np.minimum(at + i, len(hashes) - 1)], 0) for i in range(depth)]
    return np.lexsort(columns[::-1]), columns


def _search(columns: list, n: int, key: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """The range of a sorted array whose first n words are ``key``: a binary search on each word within the range so far."""
    for i in range(n):
        part = columns[i][low:high]
        low, high = low + int(np.searchsorted(part, key[i], "left")), low + int(np.searchsorted(part, key[i], "right"))
        if low == high:
            break
    return low, high


def extended(windows: dict[int, np.ndarray], size: int, doc: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, words, test word) of the longest verbatim matches, from the test windows found at each training word: a
    match goes on as long as the next window on both sides does."""
    out, open_ = [], {}
    for p in sorted(windows):
        after = {}
        if p - 1 in windows and doc[p - 1] == doc[p]:
            before = open_
        else:
            out += [(q, n + size - 1, t) for t, (q, n) in open_.items()]
            before = {}
        for t in windows[p].tolist():
            q, n = before.pop(t - 1, (p, 0))
            after[t] = (q, n + 1)
        # what did not go on has ended: test words are kept as of their last window
        out += [(q, n + size - 1, t) for t, (q, n) in before.items()]
        open_ = after
    out += [(q, n + size - 1, t) for t, (q, n) in open_.items()]
    return [(q, n, t - (n - size)) for q, n, t in out]


def scan(step: Step, tests: Tests):
    """The words of a shard, which of them are hit, and the longest verbatim matches as (start, words, item)."""
    found = words(step, WORD_CHAR)
    hashes = word_hashes(step, found, LOWER)
    hit = np.zeros(len(hashes) + 1, np.int64)
    matches: list[tuple[int, int, int]] = []
    if len(hashes) >= tests.head and len(tests.starts):
        n = len(hashes) - tests.head + 1
        ends = found.firsts[1:][found.doc]
        at = np.arange(n)
        at = at[at + tests.head <= ends[:n]]
        spans = _span(hashes, at, tests.head)
        place = np.minimum(np.searchsorted(tests.heads, spans), len(tests.heads) - 1)
        live = tests.heads[place] == spans
        at, seen_heads = at[live], np.unique(place[live])
        if len(at):
            order, columns = suffix_array(hashes, ends[at], at, tests.window)
            at, columns = at[order], [c[order] for c in columns]
            for w in tests.by_size:
                # of the benchmark only windows whose head this shard has: what is searched does not grow with the rest
                n_of = w.of_head[seen_heads + 1] - w.of_head[seen_heads]
                asked = np.arange(int(n_of.sum())) + np.repeat(w.of_head[seen_heads] - (np.cumsum(n_of) - n_of), n_of)
                low = np.searchsorted(columns[0], w.keys[asked, 0], "left")
                high = np.searchsorted(columns[0], w.keys[asked, 0], "right")
                seen: dict[int, np.ndarray] = {}
                for k, x, y in zip(asked.tolist(), low.tolist(), high.tolist(), strict=True):
                    a, b = _search(columns, w.size, w.keys[k], x, y)
                    if a == b:
                        continue
                    where = at[a:b]
                    np.add.at(hit, where, 1)
                    np.add.at(hit, where + w.size, -1)
                    seen |= dict.fromkeys(where.tolist(), w.starts[w.low[k] : w.high[k]])
                matches += [(q, n, int(tests.item[t])) for q, n, t in extended(seen, w.size, found.doc)]
    return found, np.flatnonzero(np.cumsum(hit)[:-1] > 0), sorted(matches)


def _scanner(tests: Tests):
    kind = pa.list_(pa.struct([("at", pa.int32()), ("words", pa.int32()), ("item", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch.column("text"), SHARD):
                found, where, matches = scan(step, tests)
                by = np.searchsorted(where, found.firsts)
                own = (where - found.firsts[found.doc[where]]).astype(np.int32)
                hits = pa.ListArray.from_arrays(pa.array(by.astype(np.int32)), pa.array(own))
                named: list[set] = [set() for _ in range(step.n)]
                listed: list[list] = [[] for _ in range(step.n)]
                for q, n, item in matches:
                    d = int(found.doc[q])
                    if tests.ids[item] is not None:
                        named[d].add(tests.ids[item])
                    listed[d].append({"at": q - int(found.firsts[d]), "words": n, "item": tests.ids[item]})
                part = batch.slice(step.first, step.n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("__key"), part.column("__id"), pa.array(found.counts, pa.int64()), hits, pa.array([sorted(x) for x in named], pa.list_(pa.string())), pa.array(listed, kind)],
                    names=["__key", "__id", "n_words", "hits", "items", "matches"],
                )

    return run


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[tuple[list, list]]:
    """The benchmark in (ids, texts) of a bounded size, streamed to the driver partition by partition; one at least."""
    ids, texts, size = [], [], 0
    for row in items.toLocalIterator():
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += len((row["text"] or "").encode())
        if size >= block_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _in_blocks(benchmark: DataFrame, item_col: str, block_bytes: int) -> tuple[tuple[list, list], Iterator]:
    """The first block, and an iterator over all blocks if there are more, else None."""
    blocks = _blocks(pick(benchmark, item_col, "text").toDF("item_id", "text"), block_bytes)
    first = next(blocks, ([], []))
    second = next(blocks, None)
    return first, None if second is None else chain([first, second], blocks)


def _matches(docs: DataFrame, sent) -> DataFrame:
    def run(batches):
        yield from _scanner(sent.value)(batches)

    return docs.select("__key", "__id", "text").mapInArrow(run, SCHEMA)


def _block_by_block(docs: DataFrame, blocks: Iterator, window: int) -> DataFrame:
    """The hits of rows (__key, __id, text) with all blocks, a row for each key. A block is sent, searched, its hits written,
    and the block dropped by tasks and driver before the next one is read."""
    spark, parts = docs.sparkSession, []
    for block in blocks:
        sent = spark.sparkContext.broadcast(Tests(*block, window))
        found = _matches(docs, sent)
        parts.append(checkpoint(found if not parts else found.filter(F.size("hits") > 0)))
        sent.destroy()
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    joined = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)  # noqa: E731  as much as a text has, a few blocks each
    return every.groupBy("__key").agg(F.max("__id").alias("__id"), F.max("n_words").alias("n_words"), joined("hits"), joined("items"), joined("matches"))


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document (id, n_words, n_hit, items array<string>, contaminated, matches, longest).

    Words are runs of ASCII letters (A-Z lower-cased), digits and non-ASCII characters. A window is ``window``
    consecutive words of an item, or the whole of a shorter item that has words. Each task sorts the suffixes of its
    shard of the training text, looks test windows up by binary search and marks all suffixes in the range found, so
    no document moves. Only suffixes whose first words start some window take part, and only windows that start so; the
    others cannot match. matches are the longest verbatim matches, (at, words, item) with the place counted in words, and
    longest is the longest of them (0 for none). Null texts have no words; an empty benchmark hits nothing. An item without
    id hits like others, but is not listed in items; items that share an id are one in items. Rows alike in id and text get
    equal results. A benchmark over ``block_bytes`` is searched in blocks whose results are merged by document; driver and
    tasks hold one of them at a time.
    """
    docs = pick(docs, id_col, text_col).toDF("__id", "text").withColumn("__id", F.col("__id").cast("long"))
    first, blocks = _in_blocks(benchmark, item_col, block_bytes)
    if blocks is None:
        found = _matches(docs.withColumn("__key", F.lit(0).cast("long")), docs.sparkSession.sparkContext.broadcast(Tests(*first, window)))
    else:
        keyed = with_row_key(docs, "__id")
        each, rows = once(keyed)
        found = _block_by_block(each, blocks, window)
        if rows is not None:
            found = found.join(rows, "__key").withColumn("__rows", F.explode(F.sequence(F.lit(1), F.col("__rows").cast("int"))))
    return found.select(F.col("__id").alias(id_col), "n_words", F.size("hits").cast("long").alias("n_hit"), F.array_sort("items").alias("items"), (F.size("hits") > 0).alias("contaminated"), F.array_sort("matches").alias("matches"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["words"])), F.lit(0)).alias("longest"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Drops every document that holds a window of a benchmark item; columns and all other rows stay as they are, whatever
    the columns are called. Null texts and empty tables hold nothing; rules as in benchmark_hits.

    The decision is made where the document is read, so nothing is shuffled or joined, if the benchmark is one block;
    documents hit in any of more blocks are left out by their key.
    """
    first, blocks = _in_blocks(benchmark, item_col, block_bytes)
    at = docs.columns.index(text_col)
    if blocks is None:
        sent = docs.sparkSession.sparkContext.broadcast(Tests(*first, window))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bad = np.zeros(batch.num_rows, bool)
                for step in steps(batch.column(at), SHARD):
                    found, where, _ = scan(step, sent.value)
                    bad[step.first + found.doc[where]] = True
                yield batch.filter(pa.array(~bad))

        return map_rows(docs, run)
    names = docs.columns
    inner = docs.toDF(*[f"__c{i}" for i in range(len(names))])
    own = {"__id": F.col(f"__c{names.index(id_col)}").cast("long"), "text": F.col(f"__c{at}")}
    keyed = with_row_key(inner.withColumns(own), "__id")
    hit = _block_by_block(once(keyed)[0], blocks, window).filter(F.size("hits") > 0).select("__key")
    return keyed.join(hit, "__key", "left_anti").select(*[f"__c{i}" for i in range(len(names))]).toDF(*names)
