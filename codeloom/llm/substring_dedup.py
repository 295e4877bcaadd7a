"""Removes passages of some words that occur more than once, found level by level."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, pick, with_row_key
from .textscan import NOT_SPACE, Step, Words, inside_documents, mix, steps, windows, word_hashes, words


def levels(length: int) -> tuple[int, int, int]:
    """The window lengths: each twice the one before, the last two overlapping by a word where ``length`` is odd."""
    half = -(-length // 2)
    return -(-half // 2), half, length


def sliding(x: np.ndarray, n: int, f) -> np.ndarray:
    """f (minimum or maximum) over all windows of n items, by doubling."""
    have = 1
    while have < n:
        add = min(have, n - have)
        x = f(x[:-add], x[add:])
        have += add
    return x


def owners(small: np.ndarray, inside: np.ndarray, span: int) -> np.ndarray:
    """For each window the position of its least small-window hash, leftmost of equals; -1 where the window crosses a
    border. A function of the window's own words, so equal windows agree on the offset."""
    bits = max(1, int(len(small)).bit_length())
    low = np.uint64((1 << bits) - 1)
    keyed = (mix(small) & ~low) | np.arange(len(small), dtype=np.uint64)
    return np.where(inside, (sliding(keyed, span, np.minimum) & low).astype(np.int64), -1)


def runs(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, first window, end window) of runs of windows that share an owner."""
    if len(owner) == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    new = np.ones(len(owner), bool)
    new[1:] = owner[1:] != owner[:-1]
    first = np.flatnonzero(new)
    end = np.append(first[1:], len(owner))
    real = owner[first] >= 0
    return owner[first][real], first[real], end[real]


def _prepared(step: Step, length: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    found = words(step, NOT_SPACE)
    hashes = word_hashes(step, found)
    if len(hashes) < length:
        none = np.zeros(0, np.int64)
        return found, hashes, none.astype(np.uint64), none
    small, _, _ = levels(length)
    grams = windows(hashes, small)
    return found, hashes, grams, owners(grams, inside_documents(found, length), length - small + 1)


def _ragged(values: np.ndarray, counts: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(values, kind))


def _grouped(order: np.ndarray, new: np.ndarray, key: np.ndarray, at: np.ndarray) -> pa.Array:
    """Lists of key, at, key, at, ... for runs of ``order`` that start where ``new`` holds."""
    flat = np.empty(2 * len(order), np.int64)
    flat[0::2], flat[1::2] = key[order], at[order]
    return _ragged(flat, 2 * np.diff(np.append(np.flatnonzero(new), len(order))), pa.int64())


def _anchors(length: int):
    """Rows (gram, held) for the least small window of each run: the first level. Equal grams of a batch are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            grams, keys, ats = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for step in steps(batch.column(1)):
                found, _, small, owner = _prepared(step, length)
                at, _, _ = runs(owner)
                grams.append(small[at])
                doc = found.doc[at]
                keys.append(rows[step.first + doc])
                ats.append(at - found.firsts[doc])
            gram, key, at = np.concatenate(grams), np.concatenate(keys), np.concatenate(ats)
            order = np.argsort(gram, kind="stable")
            new = np.ones(len(order), bool)
            new[1:] = gram[order][1:] != gram[order][:-1]
            yield pa.RecordBatch.from_arrays([pa.array(gram[order][new].view(np.int64)), _grouped(order, new, key, at)], names=["gram", "held"])

    return run


def _extended(length: int):
    """Rows (half, wins, held) of the surviving anchors: windows of full length owned by the anchor, by the half-length
    window that all of them contain (the one that ends the anchor, or the one that starts it)."""
    small, half, _ = levels(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.asarray(batch.column("__key").to_numpy(zero_copy_only=False), np.int64)
            lists = batch.column("ats")
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py() if len(lists) else np.zeros(1, np.int32)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            out: list[list] = [[], [], [], [], []]
            for step in steps(batch.column("text")):
                found, hashes, grams, owner = _prepared(step, length)
                at, first, end = runs(owner)
                if not len(at):
                    continue
                live = np.zeros(len(hashes) + 1, bool)
                mine = slice(offsets[step.first], offsets[step.first + step.n])
                of = np.repeat(np.arange(step.n), np.diff(offsets[step.first : step.first + step.n + 1]))
                live[found.firsts[of] + flat[mine]] = True
                real = live[at]
                at, first, end = at[real], first[real], end[real]
                if not len(at):
                    continue
                halves, wins = windows(hashes, half), windows(hashes, length)
                back = half - small  # a window that starts here or earlier, seen from the anchor, holds the half that ends with the anchor
                cut = np.clip(at - back + 1, first, end)
                for low, high, start in ((first, cut, at - back), (cut, end, at)):
                    some = high > low
                    n = (high - low)[some]
                    doc = found.doc[at[some]]
                    out[0].append(halves[start[some]])
                    out[1].append(n)
                    out[2].append(wins[np.arange(int(n.sum())) + np.repeat(low[some] - (np.cumsum(n) - n), n)])
                    out[3].append(rows[step.first + doc])
                    out[4].append(low[some] - found.firsts[doc])
            if not out[0]:
                continue
            key_half, n, wins, key, at = map(np.concatenate, out)
            # rows whose windows are the same are one row
            starts = np.cumsum(n) - n
            whole = mix(np.add.reduceat(mix(wins ^ np.repeat(key_half, n)) * (2 * (np.arange(len(wins)) - np.repeat(starts, n)).astype(np.uint64) + np.uint64(1)), starts)) if len(wins) else key_half
            order = np.lexsort((whole, n, key_half))
            new = np.ones(len(order), bool)
            new[1:] = (key_half[order][1:] != key_half[order][:-1]) | (whole[order][1:] != whole[order][:-1]) | (n[order][1:] != n[order][:-1])
            head = order[new]
            pick_ = np.arange(int(n[head].sum())) + np.repeat(starts[head] - (np.cumsum(n[head]) - n[head]), n[head])
            yield pa.RecordBatch.from_arrays([pa.array(key_half[head].view(np.int64)), _ragged(wins[pick_].view(np.int64), n[head], pa.int64()), _grouped(order, new, key, at)], names=["half", "wins", "held"])

    return run


def _pairs(name: str):
    """Explodes a list key, at, key, at, ..."""
    n = F.expr(f"sequence(0, size({name}) div 2 - 1)")
    return F.inline(F.transform(n, lambda i: F.struct(F.get(F.col(name), 2 * i).alias("__key"), F.get(F.col(name), 2 * i + 1).cast("int").alias("at"))))


def repeated_windows(texts: DataFrame, length: int) -> DataFrame:
    """Rows (__key, at, mask): bit i of mask says that the window of ``length`` words at word at + i of the document starts
    elsewhere too. texts has __key and text; its other columns only make both joins with it read the same exchange.

    First level: of every full-length window only its least quarter-length window is looked at (about one word in
    fourteen), and only those seen at least twice survive. Second and third level: survivors are extended to half-length
    windows, survivors of those to the full length, which is exact. Hashes have 64 bits a level, and a full window is
    compared within its half-length group, so 128 together. A task sends equal windows of a batch once, with the places;
    group sizes then are sums over such rows.
    """
    anchors = texts.select("__key", "text").mapInArrow(_anchors(length), "gram long, held array<long>")
    anchors = anchors.withColumn("n", F.sum(F.size("held")).over(W.partitionBy("gram"))).filter("n > 2")
    alive = anchors.select(_pairs("held")).groupBy("__key").agg(F.collect_list("at").alias("ats"))
    extended = texts.join(alive, "__key").mapInArrow(_extended(length), "half long, wins array<long>, held array<long>")
    extended = extended.withColumn("n", F.sum(F.size("held")).over(W.partitionBy("half"))).filter("n > 2").drop("n")
    single = extended.select("half", "held", F.posexplode("wins").alias("i", "win"))
    counted = single.withColumn("n", F.sum(F.size("held")).over(W.partitionBy("half", "win"))).filter("n > 2")
    return counted.groupBy("half", "held").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("mask")).select(_pairs("held"), "mask")


def _at_starts(length: int):
    """Rows (__key, at, h1, h2) for the windows of ``length`` words at given starts, where they fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.asarray(batch.column("__key").to_numpy(zero_copy_only=False), np.int64)
            lists = batch.column("ats")
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py() if len(lists) else np.zeros(1, np.int32)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            for step in steps(batch.column("text")):
                found = words(step, NOT_SPACE)
                of = np.repeat(np.arange(step.n), np.diff(offsets[step.first : step.first + step.n + 1]))
                at = flat[offsets[step.first] : offsets[step.first + step.n]].astype(np.int64)
                fits = at + length <= found.counts[of]
                of, at = of[fits], at[fits]
                if len(at):
                    first = found.firsts[of] + at
                    both = [windows(word_hashes(step, found, seed=k), length)[first].view(np.int64) for k in (1, 2)]
                    yield pa.RecordBatch.from_arrays([pa.array(rows[step.first + of]), pa.array(at.astype(np.int32)), *map(pa.array, both)], names=["__key", "at", "h1", "h2"])

    return run


def longest_repeats(docs: DataFrame, length: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document with a repeated window (id, longest): the greatest of length, 2 * length, 4 * length, ... such that a
    window of so many words that starts with a sampled repeated one starts elsewhere too.

    Windows repeated at one length are extended to twice that length, and only they, until no candidates survive. Each
    round counts hashes of 128 bits over what is left and writes its survivors. Long repeats hold many sampled starts;
    one is the first window of each run that repeated_windows compares. Null texts and documents without repeats have no
    row; rows alike in id and text share one."""
    docs = with_row_key(pick(docs, id_col, text_col).toDF("__id", "text"), "__id")
    starts = checkpoint(repeated_windows(docs, length).filter("mask & 1 = 1").select("__key", "at"))
    out = starts.select("__key").distinct().withColumn("longest", F.lit(length))
    size = length
    while True:
        size *= 2
        held = starts.groupBy("__key").agg(F.collect_list("at").alias("ats"))
        wins = docs.join(held, "__key").mapInArrow(_at_starts(size), "__key long, at int, h1 long, h2 long")
        wins = checkpoint(wins)
        again = wins.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        starts = checkpoint(wins.join(again, ["h1", "h2"], "left_semi").select("__key", "at"))
        if starts.isEmpty():
            break
        out = out.unionByName(starts.select("__key").distinct().withColumn("longest", F.lit(size)))
    longest = out.groupBy("__key").agg(F.max("longest").alias("longest"))
    return docs.select("__key", F.col("__id").alias(id_col)).distinct().join(longest, "__key").drop("__key")


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("hits")
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py() if len(lists) else np.zeros(1, np.int32)
            ats, masks = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in lists.flatten().flatten())
            n_words, n_removed, kept = [], [], []
            for step in steps(batch.column("text")):
                found = words(step, NOT_SPACE)
                cover = np.zeros(len(found.starts) + 1, np.int64)
                low, high = offsets[step.first], offsets[step.first + step.n]
                of = np.repeat(np.arange(step.n), np.diff(offsets[step.first : step.first + step.n + 1]))
                at, mask = ats[low:high] + found.firsts[of], masks[low:high]
                for i in range(length - levels(length)[0] + 1):
                    start = at[(mask >> i) & 1 == 1] + i
                    np.add.at(cover, start, 1)
                    np.add.at(cover, start + length, -1)
                gone = np.cumsum(cover)[:-1] > 0
                raw = step.data.tobytes()
                starts, ends = found.starts.tolist(), found.ends.tolist()
                stay = np.flatnonzero(~gone)
                by = np.searchsorted(stay, found.firsts).tolist()
                stay = stay.tolist()
                n_words.append(found.counts)
                n_removed.append(found.counts - np.diff(by))
                kept += [b" ".join([raw[starts[i] : ends[i]] for i in stay[by[d] : by[d + 1]]]) for d in range(step.n)]
            texts = pa.array(kept, pa.binary()).cast(pa.string())
            sums = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (n_words, n_removed)]
            sha = pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("__id"), texts, pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.int64()), sha], names=["__id", "text", "n_words", "n_removed", "kept_sha256"])

    return run


def substring_dedup(docs: DataFrame, length: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document (id, text of the words left joined by blanks, n_words, n_removed, kept_sha256).

    Words are separated by ASCII white space and compared unchanged. Every word in a window of ``length`` words whose
    words also start anywhere else, the same document included, goes; windows are judged on the input. Shorter documents
    lose nothing; null and empty texts have no words. Repeated rows are copies of each other. ``length`` is 8 to 64.
    """
    if not 8 <= length <= 64:
        raise ValueError("length must be from 8 to 64")
    docs = with_row_key(pick(docs, id_col, text_col).toDF("__id", "text"), "__id")
    found = repeated_windows(docs, length).groupBy("__key").agg(F.collect_list(F.struct("at", "mask")).alias("hits"))
    joined = docs.join(found, "__key", "left").select(F.col("__id").cast("long").alias("__id"), "text", "hits")
    cut = joined.mapInArrow(_cut(length), "__id long, text string, n_words long, n_removed long, kept_sha256 string")
    return cut.withColumnRenamed("__id", id_col).withColumnRenamed("text", text_col)
