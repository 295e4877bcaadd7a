"""Scores texts with a probabilistic suffix tree over words."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, pick, settle, stored
from .textscan import LOWER, NOT_SPACE, Step, grouped, mix, steps, word_hashes, words

#: The token that ends every text; its hash stands for no word.
END = np.uint64(0x0E0D0E0D0E0D0E0D)
#: Stands for the words that a context lacks before the beginning of its text.
NONE = np.uint64(0x3C5A3C5A3C5A3C5A)
#: Defaults of score_texts: least occurrences of a context and of a next word that it tells apart, at every size of the
#: corpus, and words of the longest context.
LEAST_CONTEXT, LEAST_NEXT, DEPTH = 10, 2, 3
#: Words whose counts are sent to the tasks, the most frequent ones first. The others are sent by their hashes, and their
#: counts to the parts that ask for them: no such bound changes a result.
HEAD_WORDS = 500_000
#: Contexts and entries are made and used where the tokens after them are, and no longer sent to the tasks: these bounds and
#: the size of a filter have no effect.
HEAD_CONTEXTS, HEAD_ENTRIES, FILTER = 1_000_000, 4_000_000, 1 << 20
#: Parts that tokens are dealt to by the word before them (at most 512), and those that rare words are counted in.
PARTS, BUCKETS = 512, 128
#: Words that occur more often deal the tokens after them to as many parts as they have this number of occurrences.
HEAVY = 1 << 20
#: Tokens of a part that are in memory at once.
ROOM = 1 << 20
DISCOUNT = 0.5
#: What a row of ROWS holds: the numbers of some texts, tokens of these texts, counts of words, entries and sums of heavy words.
TEXTS, TOKENS, COUNTS, PAIRS, SUMS = range(5)
ROWS = "part int, kind int, uid long, n int, data binary, more binary"


def tokens(step: Step) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with one END after each text, and n + 1 offsets."""
    found = words(step, NOT_SPACE)
    hashes = word_hashes(step, found, LOWER)
    out = np.full(len(hashes) + step.n, END)
    out[np.arange(len(hashes)) + found.doc] = hashes
    return out, found.firsts + np.arange(step.n + 1)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [tokens(s)[0] for s in steps(batch.column(0))]
        if parts:
            value, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], names=["w", "n"])


def find(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Positions of x in a sorted table, -1 where absent."""
    if not len(table):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return np.where(table[at] == x, at, -1)


class Lookup:
    """A sorted table of hashes with the place where each run of equal highest bits starts: a search reads one or two places
    where a binary search reads twenty."""

    def __init__(self, table: np.ndarray):
        bits = max(1, len(table).bit_length())
        self.table, self.shift = table, np.uint64(64 - bits)
        self.starts = np.zeros((1 << bits) + 1, np.int32)
        np.cumsum(np.bincount((table >> self.shift).astype(np.int64), minlength=1 << bits), out=self.starts[1:])

    def find(self, x: np.ndarray) -> np.ndarray:
        """As the function of that name."""
        out = np.full(len(x), -1, np.int32)
        run = (x >> self.shift).astype(np.int64)
        at, end = self.starts[run], self.starts[run + 1]
        left = np.flatnonzero(at < end)
        x, at, end = x[left], at[left], end[left]
        while len(left):
            hit = self.table[at] == x
            out[left[hit]] = at[hit]
            at += 1
            on = ~hit & (at < end)
            left, x, at, end = left[on], x[on], at[on], end[on]
        return out


def turned(x: np.ndarray) -> np.ndarray:
    return (x << np.uint64(17)) | (x >> np.uint64(47))


def grams(value: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For tokens with k words before them in their text: places, hashes of these words, of the words after the first of
    them with the token, and of all. Words are added to a hash in a way that columns can undo: turned(context) ^ word."""
    if len(value) <= k:
        none = np.zeros(0, np.uint64)
        return np.zeros(0, np.int64), none, none, none
    own, short = np.flatnonzero(doc[:-k] == doc[k:]), value
    for i in range(1, k):
        short = turned(short[:-1]) ^ value[i:]
    c = short[own]
    return own + k, c, short[own + 1], turned(c) ^ value[own + k]


def _least(rows: DataFrame, count: str, room: int) -> int:
    """The least count such that at most ``room`` rows have as much; 0 if all rows fit. Counts from 1,024 on go by powers of 2."""
    step = F.when(F.col(count) < 1024, F.col(count)).otherwise(F.shiftleft(F.lit(1).cast("long"), 10) * F.pow(F.lit(2), F.floor(F.log2(F.col(count) / 1024))).cast("long"))
    least = 1 << 62
    for r in rows.groupBy(step.alias("from")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("from")).collect():
        room -= r["n"]
        if room < 0:
            return least
        least = r["from"]
    return 0


def _table(rows: DataFrame, key: str, value: str, kind: str = "float") -> tuple[np.ndarray, np.ndarray]:
    found = rows.select(key, F.col(value).cast(kind)).toArrow()
    hashes = found[key].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], found[value].to_numpy().astype("f4" if kind == "float" else "f8")[order]


def found_once(look, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions that ``look`` finds of the distinct values, -1 where absent, and the number of each value among them."""
    order, head = grouped(value)
    number = np.empty(len(value), np.int64)
    number[order] = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(value))))
    return look(value[order[head]]), number


class Head(NamedTuple):
    """What is sent to the tasks. Codes are places in ``hashes``; words that are not sent have the next one."""

    depth: int
    least_context: int
    least_next: int
    total: int  #: training tokens
    vocabulary: int
    parts: int
    room: int
    sent: np.ndarray  #: hashes of frequent words, sorted
    code: np.ndarray  #: their codes, and that of all other words
    hashes: np.ndarray  #: by code: the end, no word, the frequent words
    counts: np.ndarray  #: by code; one more for words that are not sent
    heavy: np.ndarray  #: by code: the number of a word whose tokens are dealt to several parts, else -1
    over: np.ndarray  #: to how many, by that number
    heavy_codes: np.ndarray
    heavy_kept: np.ndarray  #: whether the context of this word alone is kept
    heavy_loglam: np.ndarray

    @property
    def rare(self) -> int:
        return len(self.hashes)

    def share(self, c):
        return (c + 0.1) / (self.total + 0.1 * (self.vocabulary + 1))

    def codes(self, value: np.ndarray) -> np.ndarray:
        return np.where(value == END, 0, self.code[find(self.sent, value)]).astype(np.uint32)


def make_head(sent: np.ndarray, counts: np.ndarray, ends: float, total: int, vocabulary: int, least_context: int, least_next: int, depth: int) -> Head:
    """From frequent words (sorted hashes, the end not among them) and how often they and the end occur."""
    most = np.argsort(-counts, kind="stable")
    code = np.empty(len(sent) + 1, np.uint32)
    code[most], code[-1] = np.arange(2, len(sent) + 2), len(sent) + 2
    counts = np.concatenate([[ends, 0], counts[most], [0]]).astype(float)
    numbered = np.flatnonzero(counts > max(HEAVY, least_context, least_next))
    numbered = numbered[numbered > 1]
    heavy = np.full(len(counts), -1, np.int32)
    heavy[numbered] = np.arange(len(numbered))
    least_context, least_next = max(1, least_context), max(1, least_next)
    over = np.minimum(PARTS, -(-counts[numbered] // HEAVY)).astype(np.uint64)
    hashes = np.concatenate([np.array([END, NONE], np.uint64), sent[most]])
    none = np.zeros(len(numbered))
    return Head(depth, least_context, least_next, total, vocabulary, PARTS, ROOM, sent, code, hashes, counts, heavy, over, numbered, none > 0, none)


class Sequences(NamedTuple):
    """The tokens of a step with a word before them, each with ``depth`` words before it."""

    doc: np.ndarray
    value: list[np.ndarray]  #: hashes: the token, the word before it, the one before that
    code: list[np.ndarray]
    part: np.ndarray


def sequences(value: np.ndarray, code: np.ndarray, firsts: np.ndarray, head: Head) -> Sequences:
    sizes = np.diff(firsts)
    doc, place = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(value)) - np.repeat(firsts[:-1], sizes)
    at = np.flatnonzero(place > 0)
    value, code, place = np.append(value, NONE), np.append(code, np.uint32(1)), place[at]
    where = [at, *(np.where(place >= k, at - k, -1) for k in range(1, head.depth + 1))]
    values, codes = [value[x] for x in where], [code[x] for x in where]
    part = values[1] % np.uint64(head.parts)
    heavy = head.heavy[codes[1]]
    own = np.flatnonzero(heavy >= 0)
    further = values[2][own] if head.depth > 1 else values[0][own]
    part[own] = (part[own] + mix(further) % head.over[heavy[own]]) % np.uint64(head.parts)
    return Sequences(doc[at], values, codes, part)


def coded(value: np.ndarray, head: Head) -> np.ndarray:
    codes, number = found_once(head.codes, value)
    return codes[number]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["part", "kind", "uid", "n", "data", "more"])


def _cuts(part: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, from, to) of the parts in an ascending column."""
    at = np.searchsorted(part, np.arange(parts + 1, dtype=part.dtype))
    return [(int(i), int(at[i]), int(at[i + 1])) for i in np.flatnonzero(at[1:] > at[:-1])]


def _arrays(rows: list[bytes], *kinds: str) -> list[np.ndarray]:
    """Columns that stand one after the other in each row."""
    size, out = sum(np.dtype(k).itemsize for k in kinds), [[np.zeros(0, k)] for k in kinds]
    for row in rows:
        n, at = len(row) // size, 0
        for column, kind in zip(out, kinds, strict=True):
            column.append(np.frombuffer(row, kind, n, at))
            at += column[-1].nbytes
    return [np.concatenate(x) for x in out]


def _ask(shared):
    """Rows (part, data, more) from (text, trains), one for a bucket of words and a step: rare words with the parts that need their
    counts, and occurrences of words after heavy ones in training. A part needs the words that it has training tokens of, and
    those after heavy words, since entries there may come from the training tokens of other parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = shared.value
        for batch in batches:
            trains = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for step in steps(batch.column(0)):
                value, firsts = tokens(step)
                s = sequences(value, coded(value, head), firsts, head)
                heavy, train = head.heavy[s.code[1]] >= 0, trains[step.first : step.first + step.n][s.doc]
                rare, after = np.flatnonzero((s.code[0] == head.rare) & (heavy | train)), np.flatnonzero(heavy & train)
                order, first = grouped(s.value[0][rare] ^ mix(s.part[rare]))
                rare = rare[order[first]]
                g = turned(s.value[1][after]) ^ s.value[0][after]
                order, first = grouped(g)
                times, after = np.diff(np.append(first, len(g))), after[order[first]]
                data = {}
                for i, rows, columns in ((0, rare, [(s.value[0], "u8"), (s.part, "u2")]), (1, after, [(s.value[0], "u8"), (head.heavy[s.code[1]], "i4")])):
                    bucket = s.value[0][rows] % np.uint64(BUCKETS)
                    order = np.argsort(bucket, kind="stable")
                    found = [x[rows[order]].astype(k) for x, k in columns] + ([times[order].astype("u4")] if i else [])
                    for b, low, high in _cuts(bucket[order], BUCKETS):
                        data.setdefault(b, [b"", b""])[i] = b"".join(x[low:high].tobytes() for x in found)
                yield _rows([(b, SUMS, 0, 0, *x) for b, x in data.items()])

    return run


def _answer(shared) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Rows of ROWS from what the tasks ask for and the counts (w, n) of a bucket of rare words: counts of words for each part
    that asked, entries after a heavy word for all of its parts, and what the entries add to the sums of heavy contexts."""

    def run(asked: pa.Table, counts: pa.Table) -> pa.Table:
        head = shared.value
        table = counts.column("w").to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(table)
        table, n = table[order], np.append(counts.column("n").to_numpy()[order].astype(float), 0.0)
        out = []
        w, part = _arrays(asked.column("data").to_pylist(), "u8", "u2")
        at = find(table, w)
        w, part, at = w[at >= 0], part[at >= 0], at[at >= 0]
        order = np.lexsort((w, part))
        w, part, at = w[order], part[order], at[order]
        new = np.append(True, (w[1:] != w[:-1]) | (part[1:] != part[:-1]))[: len(w)]
        w, part, at = w[new], part[new], at[new]
        for p, low, high in _cuts(part, head.parts):
            out.append((p, COUNTS, 0, high - low, w[low:high].tobytes() + n[at[low:high]].tobytes(), b""))
        w, heavy, times = _arrays(asked.column("more").to_pylist(), "u8", "i4", "u4")
        order = np.lexsort((w, heavy))
        w, heavy, times = w[order], heavy[order], times[order]
        first = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (heavy[1:] != heavy[:-1]))[: len(w)])
        if len(first):
            times = np.add.reduceat(times.astype(float), first)
            often = times >= head.least_next
            w, heavy, times = w[first[often]], heavy[first[often]], times[often]
            code = head.codes(w)
            q = head.share(np.where(code == head.rare, n[find(table, w)], head.counts[code]))
            p, words = times / head.counts[head.heavy_codes[heavy]], head.hashes[head.heavy_codes]
            sums = np.stack([np.bincount(heavy, x, len(words)) for x in (np.ones(len(w)), p, q, p * np.log(p / q))])
            out.append((-1, SUMS, 0, 0, sums.tobytes(), b""))
            for i, low, high in _cuts(heavy, len(words)):
                data = (turned(words[i]) ^ w[low:high]).tobytes() + times[low:high].tobytes()
                out += [(int((words[i] + np.uint64(j)) % np.uint64(head.parts)), PAIRS, i, high - low, data, b"") for j in range(int(head.over[i]))]
        return pa.Table.from_batches([_rows(out)])

    return run


def _send(shared, texts: bool = True):
    """Rows of ROWS from (text, trains, id): one with the numbers of a step's texts, and one for each part with the tokens of the
    step that it has, compressed: bytes of the codes of a token and the words before it and of its text's number, the lowest
    ones of all tokens first; hashes of words without a code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, codec = shared.value, pa.Codec("zstd")
        uid = TaskContext.get().partitionId() << 32
        for batch in batches:
            trains = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint32)
            for step in steps(batch.column(0)):
                value, firsts = tokens(step)
                code = coded(value, head)
                s, rows = sequences(value, code, firsts, head), []
                if texts:
                    ids = batch.column(2).slice(step.first, step.n)
                    doc = np.repeat(np.arange(step.n), np.diff(firsts))
                    common = code != head.rare
                    base = np.bincount(doc, np.where(common, np.log10(head.share(head.counts[code])), 0.0), step.n)
                    known = np.bincount(doc, common & (head.counts[code] > 0), step.n)
                    numbers = (ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False).astype("i8"), np.diff(firsts), known.astype("i8"), base)
                    rows.append((uid % head.parts, TEXTS, uid, step.n, b"".join(x.tobytes() for x in numbers), b""))
                # by part, then by the word before, then by the token
                low = np.uint64((1 << len(s.doc).bit_length()) - 1)
                key = (s.part << np.uint64(55)) | ((s.value[1] >> np.uint64(44)) << np.uint64(35)) | ((s.value[0] >> np.uint64(49)) << np.uint64(20))
                key = (key & ~low) | np.arange(len(key), dtype=np.uint64)
                key.sort()
                order = (key & low).astype(np.int64)
                columns = [x[order] for x in s.code] + [s.doc[order].astype(np.uint32) * np.uint32(2) + trains[step.first : step.first + step.n][s.doc[order]]]
                planes = np.empty((len(columns), 4, len(order)), np.uint8)
                for plane, x in zip(planes, columns, strict=True):
                    plane[:] = x.view(np.uint8).reshape(-1, 4).T
                rare = [x == head.rare for x in columns[:-1]]
                others = [v[order[r]] for v, r in zip(s.value, rare, strict=True)]
                starts = [np.append(0, np.cumsum(r)) for r in rare]
                for p, a, b in _cuts(s.part[order], head.parts):
                    data = codec.compress(planes[:, :, a:b].tobytes(), asbytes=True)
                    rows.append((p, TOKENS, uid, b - a, data, b"".join(o[at[a] : at[b]].tobytes() for o, at in zip(others, starts, strict=True))))
                uid += 1
                yield _rows(rows)

    return run


def _opened(n: int, data: bytes, more: bytes, head: Head, codec) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """Codes, hashes, numbers of texts and whether they train, of the tokens of a row."""
    planes = np.frombuffer(codec.decompress(data, n * 4 * (head.depth + 2)), np.uint8).reshape(head.depth + 2, 4, n)
    columns = [np.ascontiguousarray(x.T).view(np.uint32).ravel() for x in planes]
    hashes, others, at = np.append(head.hashes, np.uint64(0)), np.frombuffer(more, np.uint64), 0
    values = []
    for code in columns[:-1]:
        values.append(hashes[code])
        rare = np.flatnonzero(code == head.rare)
        values[-1][rare] = others[at : at + len(rare)]
        at += len(rare)
    return columns[:-1], values, columns[-1] >> np.uint32(1), columns[-1] & np.uint32(1)


class Groups(NamedTuple):
    order: np.ndarray  #: places in an order in which equal hashes stand together
    first: np.ndarray  #: where in it each group starts
    number: np.ndarray  #: the group of each place

    def sums(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x[self.order], self.first) if len(x) else np.zeros(0)


def groups(hashes: np.ndarray) -> Groups:
    order, first = grouped(hashes)
    ordered = hashes[order]
    if (ordered[1:] < ordered[:-1]).any():  # different hashes with the same highest bits
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(hashes)])
    number = np.empty(len(hashes), np.int64)
    number[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(hashes))))
    return Groups(order, first, number)


class Learnt(NamedTuple):
    gain: np.ndarray  #: log10 of the probability of each sequence's last word over its base probability
    before: np.ndarray  #: how often the word before it occurs
    contexts: list[tuple[np.ndarray, np.ndarray]]  #: of each order: hashes of kept contexts, log10 of what they leave to their suffix's distribution
    entries: list[tuple[np.ndarray, np.ndarray]]  #: hashes of kept contexts' words with a next one, log10 of its probability over the base one


def learn(value: list[np.ndarray], times: np.ndarray, share: np.ndarray, heavy: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray, head: Head) -> Learnt:
    """Of different sequences (tokens with the words before them, nearest first) with how often they occur in training, where all
    sequences with the same word before the last are there: for a heavy one, all with the same two, and its entries in ``pairs``.

    Order by order, a context of ``least_context`` occurrences stays if its next-word distribution diverges from that of its
    longest kept suffix by more than its parameters cost (likelihood ratio against their number times the logarithm of its
    count). ``level`` is the probability that the longest kept suffix so far gives."""
    w, level, log_share, gain = value[0], share.copy(), np.log10(share), np.zeros(len(times))
    c, own, before = np.zeros(len(w), np.uint64), np.arange(len(w)), np.zeros(len(w))
    contexts, entries = [], []
    for k, word in enumerate(value[1:], 1):
        # words are added to a hash so that columns can undo it: turned(context) ^ word
        by = (17 * (k - 1)) % 64
        c ^= (word << np.uint64(by)) | (word >> np.uint64(64 - by)) if by else word
        if k > 1:
            own = own[word[own] != NONE]
        same = groups(c[own])
        nc, node = same.sums(times[own]), same.number
        loud = np.full(len(nc), -1)
        if k == 1:
            loud[node] = heavy
            nc = np.where(loud >= 0, head.counts[np.append(head.heavy_codes, 0)[loud]], nc)
            before = nc[node]
        on = (nc >= max(head.least_context, head.least_next))[node]
        own, node = own[on], node[on]
        g = turned(c[own]) ^ w[own]
        next_ = groups(g)
        n, one = next_.sums(times[own]), next_.order[next_.first]
        under = node[one]
        if k == 1 and len(head.heavy_codes):
            n = np.where(loud[under] >= 0, np.append(pair_counts, 0)[find(pairs, g[one])], n)
        told = n >= head.least_next
        p, q, u = n[told] / nc[under[told]], level[own[one[told]]], under[told]
        size, sum_p, sum_q, far = (np.bincount(u, x, len(nc)) for x in (np.ones(len(u)), p, q, p * np.log(p / q)))
        kept, loglam = tested(nc, size, sum_p, sum_q, far)
        if k == 1 and len(head.heavy_codes):
            kept, loglam = np.where(loud >= 0, head.heavy_kept[loud], kept), np.where(loud >= 0, head.heavy_loglam[loud], loglam)
        smooth = (n - DISCOUNT) / nc[under]
        hit = kept[node] & told[next_.number]
        at, passed = own[hit], kept[node] & ~hit
        level[at] = smooth[next_.number[hit]]
        gain[at] = np.log10(level[at]) - log_share[at]
        gain[own[passed]] += loglam[node[passed]]
        some = told & kept[under]
        leads = np.flatnonzero(kept)
        names = np.zeros(len(nc), np.uint64)
        names[node] = c[own]
        contexts.append((names[leads], loglam[leads]))
        entries.append((g[one[some]], gain[own[one[some]]]))
    return Learnt(gain, before, contexts, entries)


def tested(nc, size, sum_p, sum_q, far) -> tuple[np.ndarray, np.ndarray]:
    """Which contexts stay, and log10 of the share that each leaves to its suffix's distribution, scaled to what it doesn't tell
    apart; from their occurrences, the number of their entries, the sums of these entries' probabilities here (p) and in the
    suffix (q) and of p log(p / q)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        rest_p, rest_q = np.maximum(1e-12, 1 - sum_p), np.maximum(1e-12, 1 - sum_q)
        kept = (size > 0) & (2 * nc * (far + rest_p * np.log(rest_p / rest_q)) > (size + 1) * np.log(nc))
        return kept, np.log10(np.maximum(1e-12, 1 - sum_p + DISCOUNT * size / nc) / rest_q)


class Round(NamedTuple):
    """Tokens of a part that are in memory at once."""

    rows: list[int]  #: uid of the row of each run of tokens
    ends: np.ndarray  #: where each run ends
    doc: np.ndarray
    rare: np.ndarray  #: whether the word before the token is not sent
    number: np.ndarray  #: the sequence of each token
    learnt: Learnt


def _rounds(part: pa.Table, head: Head) -> Iterator[Round]:
    kind, uid, n = (part.column(x).to_numpy() for x in ("kind", "uid", "n"))
    data, more = part.column("data"), part.column("more")
    of = lambda k: [data[i].as_py() for i in np.flatnonzero(kind == k).tolist()]
    tables = []
    for keys, counts in (_arrays(of(COUNTS), "u8", "f8"), _arrays(of(PAIRS), "u8", "f8")):
        order = np.argsort(keys)
        tables += [keys[order], counts[order]]
    codec, blocks = pa.Codec("zstd"), np.flatnonzero(kind == TOKENS).tolist()
    rounds = -(-int(n[blocks].sum()) // head.room)
    for r in range(rounds):
        codes, values, docs, trains, rows, sizes = [], [], [], [], [], []
        for i in blocks:
            c, v, doc, train = _opened(int(n[i]), data[i].as_py(), more[i].as_py(), head, codec)
            if rounds > 1:
                key = np.where(head.heavy[c[1]] >= 0, v[1] ^ turned(v[2] if head.depth > 1 else v[0]), v[1])
                own = np.flatnonzero((mix(key) >> np.uint64(32)) * np.uint64(rounds) >> np.uint64(32) == r)
                c, v, doc, train = [x[own] for x in c], [x[own] for x in v], doc[own], train[own]
            codes.append((c[0], c[1]))
            values.append(v)
            docs.append(doc)
            trains.append(train)
            rows.append(int(uid[i]))
            sizes.append(len(doc))
        value = [np.concatenate(x) for x in zip(*values, strict=True)]
        del values
        token, before = (np.concatenate(x) for x in zip(*codes, strict=True))
        whole = np.zeros(len(token), np.uint64)
        for x in reversed(value):
            whole = turned(whole) ^ x
        same = groups(whole)
        one = same.order[same.first]
        times = same.sums(np.concatenate(trains).astype(float))
        value = [x[one] for x in value]
        count = head.counts[token[one]]
        unknown = np.flatnonzero(token[one] == head.rare)
        count[unknown] = np.append(tables[1], 0.0)[find(tables[0], value[0][unknown])]
        learnt = learn(value, times, head.share(count), head.heavy[before[one]], tables[2], tables[3], head)
        yield Round(rows, np.cumsum(sizes), np.concatenate(docs), before == head.rare, same.number, learnt)


def _score(shared):
    """Rows (uid, n, data, more) of a part: the numbers of texts as they are, and for the tokens of each row what they add to the
    scores of their texts, and what the rare words before them add to base scores and known words."""

    def run(part: pa.Table) -> pa.Table:
        head = shared.value
        home = part.filter(pc.equal(part.column("kind"), TEXTS)).select(["uid", "n", "data", "more"])
        out = []
        for x in _rounds(part, head):
            runs = np.repeat(np.arange(len(x.rows)), np.diff(x.ends, prepend=0))
            sizes = np.ones(len(x.rows), np.int64)
            np.maximum.at(sizes, runs, x.doc.astype(np.int64) + 1)
            starts = np.append(0, np.cumsum(sizes))
            place = starts[runs] + x.doc
            gain = np.bincount(place, x.learnt.gain[x.number], starts[-1])
            some = np.flatnonzero(gain)
            rare = np.flatnonzero(x.rare)
            c = x.learnt.before[x.number[rare]]
            base, known, there = (np.bincount(place[rare], y, starts[-1]) for y in (np.log10(head.share(c)), c > 0, np.ones(len(c))))
            rares = np.flatnonzero(there)
            cuts, rare_cuts = np.searchsorted(some, starts), np.searchsorted(rares, starts)
            for i, uid in enumerate(x.rows):
                at, rare_at = some[cuts[i] : cuts[i + 1]], rares[rare_cuts[i] : rare_cuts[i + 1]]
                data = (at - starts[i]).astype("u4").tobytes() + gain[at].astype("f4").tobytes()
                more = (rare_at - starts[i]).astype("u4").tobytes() + base[rare_at].tobytes() + known[rare_at].astype("u4").tobytes()
                out.append((uid, -1, data, more))
        columns = list(zip(*out, strict=True)) or [[]] * 4
        found = pa.table([pa.array(y, f.type) for y, f in zip(columns, home.schema, strict=True)], schema=home.schema)
        return pa.concat_tables([home, found])

    return run


def _sum_up(rows: pa.Table) -> pa.Table:
    """The texts of a step: (id, n_tokens, n_known, base_score, score)."""
    own = rows.column("n").to_numpy()
    first, found = np.flatnonzero(own >= 0)[0], rows.filter(pc.less(rows.column("n"), 0))
    ids, there, n, known, base = _arrays([rows.column("data")[int(first)].as_py()], "i8", "i8", "i8", "i8", "f8")
    at, gain = _arrays(found.column("data").to_pylist(), "u4", "f4")
    rare, add, more = _arrays(found.column("more").to_pylist(), "u4", "f8", "u4")
    base = base + np.bincount(rare, add, len(n))
    known = known + np.bincount(rare, more, len(n)).astype(np.int64)
    score = base + np.bincount(at, gain.astype(float), len(n))
    return pa.table([pa.array(ids, mask=there == 0), pa.array(n), pa.array(known), pa.array(base), pa.array(score)], names=["id", "n_tokens", "n_known", "base_score", "score"])


def _states(shared):
    """Kept contexts (context true) and entries of a part with their values."""

    def run(part: pa.Table) -> pa.Table:
        head, out = shared.value, [(np.zeros(0, bool), np.zeros(0, np.uint64), np.zeros(0))]
        for x in _rounds(part, head):
            for context, found in ((True, x.learnt.contexts), (False, x.learnt.entries)):
                out += [(np.full(len(h), context), h, v) for h, v in found]
        context, h, v = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"context": context, "h": h.view(np.int64), "v": v})

    return run


def dealt(docs: DataFrame, rare: DataFrame, head: Head, texts: bool = True) -> tuple[DataFrame, object, Stored | None]:
    """Rows of ROWS with the tokens of docs (text, trains, id) and all that their parts need to learn from them, the head that is
    sent to the tasks, and what is written meanwhile. ``rare`` has counts (w, n) of the words that are not sent."""
    spark, answers = docs.sparkSession, None
    some = not rare.isEmpty()
    if some or len(head.over):
        shared = spark.sparkContext.broadcast(head)
        asked = docs.select("text", "trains").mapInArrow(_ask(shared), ROWS).withColumnRenamed("part", "bucket").select("bucket", "data", "more")
        counts = rare.select(F.col("w").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("bucket"), "w", "n")
        answers = stored(asked.groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInArrow(_answer(shared), ROWS), "answers")
        shared.destroy()
        settle(spark)
        if len(head.over):
            sums = np.zeros((4, len(head.over)))
            for r in answers.rows.filter(F.col("kind") == SUMS).select("data").toLocalIterator():
                sums += np.frombuffer(r["data"]).reshape(sums.shape)
            kept, loglam = tested(head.counts[head.heavy_codes], *sums)
            head = head._replace(heavy_kept=kept, heavy_loglam=loglam)
    shared = spark.sparkContext.broadcast(head)
    rows = docs.mapInArrow(_send(shared, texts), ROWS)
    if answers:
        rows = rows.unionByName(answers.rows.filter(F.col("kind") != SUMS))
    return rows, shared, answers


class Tree(NamedTuple):
    """A context is the hash of its words, an entry that of a context's words and a next one."""

    depth: int
    total: int  #: training tokens
    vocabulary: int
    sent: np.ndarray  #: hashes of words, sorted
    counts: np.ndarray
    contexts: np.ndarray  #: kept contexts, sorted
    loglam: np.ndarray  #: log10 of the share that a context leaves to its suffix's distribution, scaled to what it doesn't tell apart
    keys: np.ndarray  #: entries, sorted
    gain: np.ndarray  #: log10 of the entry's probability over the next word's base probability

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.total + 0.1 * (self.vocabulary + 1)))


def grow(training: DataFrame, total: int, vocabulary: int, sent: np.ndarray, counts: np.ndarray, least_context: int = LEAST_CONTEXT, least_next: int = LEAST_NEXT, depth: int = DEPTH) -> Tree:
    """The tree of texts (one column, text) all of whose words are sent."""
    spark, word = training.sparkSession, sent != END
    head = make_head(sent[word], counts[word], float(counts[~word].sum()), total, vocabulary, least_context, least_next, depth)
    docs = training.select("text", F.lit(True).alias("trains"), F.lit(None).cast("long").alias("id"))
    rows, shared, answers = dealt(docs, spark.createDataFrame([], "w long, n long"), head, texts=False)
    found = rows.groupBy("part").applyInArrow(_states(shared), "context boolean, h long, v double").toArrow()
    if answers:
        answers.remove()
    context, h, v = (found.column(x).to_numpy() for x in ("context", "h", "v"))
    tables = []
    for own in (context.astype(bool), ~context.astype(bool)):
        # entries of heavy words are found in several parts
        hashes, one = np.unique(h[own].astype(np.int64).view(np.uint64), return_index=True)
        tables += [hashes, v[own][one]]
    return Tree(depth, total, vocabulary, sent, counts, *tables)


class Searches(NamedTuple):
    known: np.ndarray  #: log10 of the probability of each token over its base probability


def search(value: np.ndarray, doc: np.ndarray, tree: Tree) -> Searches:
    """Each search goes from the longest context to the shortest: an entry ends it with its gain, a context without the entry
    adds its share."""
    contexts, entries = Lookup(tree.contexts), Lookup(tree.keys)
    known, live = np.zeros(len(value)), np.ones(len(value), bool)
    for k in range(tree.depth, 0, -1):
        at, c, _, g = grams(value, doc, k)
        on = live[at]
        at, node, key = at[on], contexts.find(c[on]), entries.find(g[on])
        hit = key >= 0
        known[at[hit]] += tree.gain[key[hit]]
        live[at[hit]] = False
        passed = ~hit & (node >= 0)
        known[at[passed]] += tree.loglam[node[passed]]
    return Searches(known)


def score_texts(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", least_context: int = LEAST_CONTEXT, least_next: int = LEAST_NEXT, depth: int = DEPTH) -> DataFrame:
    """Per document (id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Tokens are words between ASCII white space, A-Z lower-cased, then one end. Rows where ``held_out`` (a column of the
    id) is not true train. The root of the tree has the smoothed frequencies (c + 0.1) / (N + 0.1 (V + 1)); a kept context
    gives the words it tells apart their discounted frequency and leaves the rest to its longest kept suffix, scaled so
    that probabilities still sum to 1. Each token is scored in the state of its longest kept suffix.

    Contexts of up to ``depth`` words with ``least_context`` occurrences are tested, and tell words apart that follow
    ``least_next`` times: numbers that don't depend on the size of the corpus; with 1 and 1 every context and every next
    word is counted. Counts cover all training texts. All contexts of a token end with the word before it, so tokens are dealt
    to parts by that word, where contexts are counted, tested and used; each text then gets the sums of its parts. Null texts
    are empty and have the end alone; without training rows N and V are 0. Rows alike in id and text are scored alike; null
    ids train.
    """
    spark = docs.sparkSession
    held = lambda x: F.coalesce(held_out(F.col(x)), F.lit(False))
    docs = pick(docs, id_col, text_col).toDF("__id", "text").select("text", (~held("__id")).alias("trains"), F.col("__id").cast("long").alias("id"))
    written = stored(docs.filter("trains").select("text").mapInArrow(_count_words, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")), "words")
    counts, end = written.rows, F.lit(int(END))
    sums = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(F.when(F.col("w") == end, F.col("n"))).alias("ends")).first()
    total, vocabulary = int(sums["n"] or 0), int(sums["v"])
    counts = counts.filter(F.col("w") != end)
    least = _least(counts, "n", HEAD_WORDS)
    settle(spark)
    head = make_head(*_table(counts.filter(F.col("n") >= least), "w", "n", "double"), float(sums["ends"] or 0), total, vocabulary, least_context, least_next, depth)
    rare = counts.filter((F.col("n") < least) & (F.col("n") >= least_next))
    rows, shared, answers = dealt(docs, rare, head)
    found = rows.groupBy("part").applyInArrow(_score(shared), "uid long, n int, data binary, more binary")
    found = found.groupBy("uid").applyInArrow(_sum_up, "id long, n_tokens long, n_known long, base_score double, score double")
    scores = stored(found, "scores").rows
    for part in (written, answers):
        if part:
            part.remove()
    settle(spark)
    return scores.select(F.col("id").alias(id_col), held("id").alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
