"""Links near-duplicate texts: b-bit MinHash finds candidates, full shingle sets confirm them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, components, pick, settle, with_row_key
from .textscan import LOWER, NOT_SPACE, Step, keys, mix, steps, windows, word_hashes, words

#: Chance that a pair at exactly the threshold shares no band.
MISS = 1e-8
#: Rows of a band, low bits kept of each minimum, and how many deviations below the threshold an estimate may lie.
ROWS, BITS, SLACK = 4, 4, 6.0
#: Pairs of 16 bytes that may be broadcast.
PAIRS_SENT = 500_000


def n_bands(similarity: float, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log1p(-(similarity**rows)))


def shingles(step: Step, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted within it, and their numbers. A document with fewer words than a
    shingle has its whole sequence as the one shingle; without words it has none."""
    found = words(step, NOT_SPACE)
    hashes = word_hashes(step, found, LOWER)
    count = found.counts
    short = np.flatnonzero((count > 0) & (count < n))
    parts, docs = [], []
    if len(hashes) >= n:
        at = np.flatnonzero(found.doc[: len(hashes) - n + 1] == found.doc[n - 1 :])
        parts.append(windows(hashes, n)[at])
        docs.append(found.doc[at])
    for size in range(1, n):
        own = short[count[short] == size]
        if len(own):
            # marked by its size: no window of full length has the same hash
            parts.append(mix(windows(hashes, size)[found.firsts[own]] + np.uint64(size)))
            docs.append(own)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(step.n, np.int64)
    value, doc = np.concatenate(parts), np.concatenate(docs)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[new], np.bincount(doc[new], minlength=step.n)


def signatures(value: np.ndarray, counts: np.ndarray, bands: int, rows: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (documents x bands) and packed low bits of the minima (documents x 64-bit words). Documents must not be empty."""
    starts = np.cumsum(counts) - counts
    n, perms = len(counts), bands * rows
    a, b = keys(perms, 11) | np.uint64(1), keys(perms, 12)
    per_word = 64 // bits
    packed = np.zeros((n, -(-perms // per_word)), np.uint64)
    band = np.zeros((n, bands), np.uint64)
    for p in range(perms):
        h = value * a[p] + b[p]
        h ^= h >> np.uint64(32)
        low = mix(np.minimum.reduceat(h, starts))
        packed[:, p // per_word] |= (low & np.uint64((1 << bits) - 1)) << np.uint64(bits * (p % per_word))
        band[:, p // rows] = mix(band[:, p // rows] + low + np.uint64(p))
    return band, packed


def set_digests(value: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that equal sets share."""
    starts = np.cumsum(counts) - counts
    return tuple(mix(np.add.reduceat(mix(value ^ np.uint64(k)), starts) + counts.astype(np.uint64)) for k in (0x5851F42D4C957F2D, 0x14057B7EF767814F))


def _signer(n: int, bands: int, rows: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch.column(2)):
                value, counts = shingles(step, n)
                some = np.flatnonzero(counts)
                s1, s2 = np.zeros(step.n, np.uint64), np.zeros(step.n, np.uint64)
                band, packed = np.zeros((step.n, bands), np.uint64), np.zeros((step.n, -(-bands * rows // (64 // bits))), np.uint64)
                if len(some):
                    s1[some], s2[some] = set_digests(value, counts[some])
                    band[some], packed[some] = signatures(value, counts[some], bands, rows, bits)
                part = batch.slice(step.first, step.n)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(step.n + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel().view(np.int64))) for x in (band, packed)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int64()), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), *lists], names=["__key", "__id", "n", "s1", "s2", "bands", "packed"])

    return run


def agreement(a, b, n_perms: int, bits: int):
    """Estimated similarity of two packed signatures: equal minima are counted in the XOR, with the share that agrees in
    its low bits by chance taken out."""
    ones = sum(1 << (bits * i) for i in range(64 // bits))
    ones = ones - (1 << 64) if ones >= 1 << 63 else ones

    def differ(x):
        folded = x
        for i in range(1, bits):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, i))
        return F.bit_count(folded.bitwiseAND(F.lit(ones).cast("long")))

    words_ = -(-n_perms // (64 // bits))
    unlike = sum((differ(F.get(a, i).bitwiseXOR(F.get(b, i))) for i in range(1, words_)), differ(F.get(a, 0).bitwiseXOR(F.get(b, 0))))
    chance = 2.0**-bits
    return (1 - unlike / n_perms - chance) / (1 - chance)


def _verifier(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sides = []
                for name in ("ta", "tb"):
                    sets: list = []
                    for step in steps(part.column(name)):
                        value, counts = shingles(step, n)
                        sets += np.split(value, np.cumsum(counts)[:-1])
                    sides.append(sets)
                good = []
                for x, y in zip(*sides, strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
                yield pa.RecordBatch.from_arrays([part.column("a").filter(pa.array(good, pa.bool_())), part.column("b").filter(pa.array(good, pa.bool_()))], names=["a", "b"])

    return run


def promising(pairs: DataFrame, heads: DataFrame, percent: int, perms: int, bits: int, least: float) -> DataFrame:
    """The pairs whose sizes allow the similarity and whose signatures are estimated at ``least`` or above."""
    side = lambda c: heads.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("packed").alias(f"p{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return checkpoint(both.filter(agreement(F.col("pa"), F.col("pb"), perms, bits) >= least).select("a", "b"))


def _setter(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch.column("text")):
                value, counts = shingles(step, n)
                part = batch.slice(step.first, step.n)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("n"), lists], names=["node", "n", "set"])

    return run


class Near(NamedTuple):
    """What the second and third round work on: texts that share a bucket with another component."""

    sets: DataFrame  #: (node, set)
    facts: DataFrame  #: (node, n, own): sizes, and how many shingles no other of these texts has
    first: DataFrame  #: (t, node, place): the shingles by which a text can be found, and their places in its order


def rare_first(open_: DataFrame, texts: DataFrame, n: int, percent: int) -> Near:
    """Counts the shingles of ``open_`` (node, n) among these texts and puts each set in one order, rarest first. Sets that
    are similar enough share a shingle among the first n - ceil(n * percent / 100) + 1 of each. Shingles of a single text
    take places, but lead nowhere and are not joined."""
    sent = F.broadcast(open_) if open_.count() <= PAIRS_SENT else open_
    sets = checkpoint(texts.join(sent, "node").mapInArrow(_setter(n), "node long, n long, set array<long>"))
    single = sets.select("node", "n", F.explode("set").alias("t"))
    common = single.groupBy("t").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    known = single.join(common, "t")
    mine = W.partitionBy("node")
    own = F.col("n") - F.count(F.lit(1)).over(mine)
    placed = known.withColumn("own", own).withColumn("place", F.col("own") + F.row_number().over(mine.orderBy("df", "t")))
    first = checkpoint(placed.filter(f"place <= n - (n * {percent} + 99) div 100 + 1").select("t", "node", "own", "place"))
    known = first.groupBy("node").agg(F.max("own").alias("own"))
    # texts that are not found have too many shingles of their own to be like any other
    facts = sets.select("node", "n").join(known, "node")
    return Near(sets.select("node", "set"), checkpoint(facts), first.select("t", "node", "place"))


def prefix_pairs(near: Near, roots: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of texts with different roots that can meet the threshold: those that share one of their first
    shingles, early enough in both orders for what follows it to be shared as well. Shingles found under one root only are
    left out first, so a large component is not joined with itself."""
    rooted = near.facts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = near.first.join(rooted, "node")
    split = first.groupBy("t").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("t")
    first = checkpoint(first.join(split, "t", "left_semi"))
    x, y = first.alias("x"), first.alias("y")
    most = 1 + F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    fits = most * (100 + percent) >= percent * (F.col("x.n") + F.col("y.n"))
    pairs = x.join(y, (F.col("x.t") == F.col("y.t")) & (F.col("x.root") < F.col("y.root")) & fits)
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def confirmed(pairs: DataFrame, near: Near, percent: int) -> DataFrame:
    """The pairs whose sets meet the threshold, where the sets are at hand."""
    held = pairs.join(near.sets.toDF("a", "sa"), "a").join(near.sets.toDF("b", "sb"), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return held.filter(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def verify(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets meet the threshold. Texts (node, text) meet their pairs by two equi-joins;
    up to PAIRS_SENT pairs, which are counted first, go to the texts instead of all texts being dealt out."""
    sent = F.broadcast(pairs) if pairs.count() <= PAIRS_SENT else pairs
    held = sent.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")
    return held.select("a", "b", "ta", "tb").mapInArrow(_verifier(n, percent), "a long, b long")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS, bits: int = BITS) -> DataFrame:
    """Per document (id, n_shingles, component_id, kept).

    Words are separated by ASCII white space, A-Z lower-cased; a document's set has its distinct ``n``-word shingles.
    Documents with 100 * intersection >= ``percent`` * union are linked, component_id is the smallest id reachable, and
    kept marks it. Texts without words, null ones too, have empty sets and are linked with nothing. Of rows that repeat
    an id all are kept or none; null ids are components of their own (null) and kept.

    Equal sets are one node from the start, so copies are never paired. Band keys then give candidates; those whose packed
    signatures put them near the threshold or above are confirmed on full sets. Not all pairs of a bucket are formed:

    1. Each member is paired with one center per bucket, the first in an order that differs by band; links are joined to
       components.
    2. In buckets with several components, each member is paired with the text that has fewest shingles of its own, which
       in a group of changed copies is the one nearest to the original.
    3. What could be missing then is links between components that share a bucket. A prefix filter finds all pairs of
       their members that can be similar: texts that share none of their rarest shingles cannot, nor can those whose
       first common one comes too late in either.

    The number of bands makes the chance to share none at the threshold 1e-8, and an estimate is trusted to six standard
    deviations.
    """
    bands = n_bands(percent / 100, rows)
    perms = bands * rows
    docs = with_row_key(pick(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("text")), "__id")
    signed = checkpoint(docs.select("__key", "__id", "text").mapInArrow(_signer(n, bands, rows, bits), "__key long, __id long, n long, s1 long, s2 long, bands array<long>, packed array<long>"))
    # one node for each distinct set: the smallest key that has it
    nodes = signed.filter("n > 0").groupBy("s1", "s2").agg(F.min("__key").alias("node"), F.min("__id").alias("least"))
    heads = signed.join(nodes.select(F.col("node").alias("__key")), "__key", "left_semi")
    heads = heads.filter("n > 0").dropDuplicates(["__key"]).select(F.col("__key").alias("node"), "n", "bands", "packed")
    heads = checkpoint(heads)
    texts = docs.select(F.col("__key").alias("node"), "text")
    if _keys_repeat(docs):
        texts = texts.dropDuplicates(["node"])

    buckets = heads.select("node", F.posexplode("bands").alias("band", "hash"))
    turn = F.xxhash64("band")  # XOR with it puts the nodes in another order for each band, and can be undone
    centers = buckets.groupBy("band", "hash").agg(F.min(F.col("node").bitwiseXOR(turn)).alias("c"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    centers = centers.select("band", "hash", F.col("c").bitwiseXOR(turn).alias("center"))
    star = buckets.join(centers, ["band", "hash"]).filter("node <> center")
    star = checkpoint(star.select(F.least("node", "center").alias("a"), F.greatest("node", "center").alias("b")).distinct())
    least = percent / 100 - SLACK * math.sqrt(percent / 100 * (1 - percent / 100) / perms)
    links = checkpoint(verify(promising(star, heads, percent, perms, bits, least), texts, n, percent))
    parts = components(links)

    placed = heads.select("node", "n", "bands").join(parts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by_band = placed.select("node", "root", "n", F.posexplode("bands").alias("band", "hash"))
    mixed = by_band.groupBy("band", "hash").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("band", "hash")
    meeting = by_band.join(mixed, ["band", "hash"], "left_semi")
    near = rare_first(checkpoint(meeting.select("node", "n").distinct()), texts, n, percent)
    told = checkpoint(meeting.select("node", "root", "band", "hash").join(near.facts.select("node", "own"), "node"))
    middle = told.groupBy("band", "hash").agg(F.min(F.struct("own", "node")).alias("m")).select("band", "hash", F.col("m.node").alias("center"))
    again = told.join(middle, ["band", "hash"]).filter("node <> center").select(F.least("node", "center").alias("a"), F.greatest("node", "center").alias("b")).distinct()
    again = checkpoint(again.join(star, ["a", "b"], "left_anti"))
    links = checkpoint(links.unionByName(confirmed(promising(again, heads, percent, perms, bits, least), near, percent)))
    settle(docs.sparkSession)
    cross = prefix_pairs(near, components(links), percent).join(star, ["a", "b"], "left_anti").join(again, ["a", "b"], "left_anti")
    more = confirmed(promising(checkpoint(cross), heads, percent, perms, bits, least), near, percent)
    links = checkpoint(links.unionByName(more))
    settle(docs.sparkSession)
    groups = components(links)

    classes = nodes.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = classes.join(lowest, "root").select("s1", "s2", "component_id")
    out = signed.select("__id", "n", "s1", "s2").join(classes, ["s1", "s2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("__id"))
    out = out.select(F.col("__id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.col(id_col).isNull()))


def _keys_repeat(docs: DataFrame) -> bool:
    return bool(docs.groupBy("__key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).take(1))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; columns and all other rows stay.

    Ids to remove are sent to the documents if there are at most PAIRS_SENT; beyond that both sides are dealt out."""
    lost = checkpoint(near_duplicates(docs, n, percent, id_col, text_col).filter("not kept").select(F.col(id_col).alias("__lost")).distinct())
    sent = F.broadcast(lost) if lost.count() <= PAIRS_SENT else lost
    names = docs.columns
    inner = docs.toDF(*[f"__c{i}" for i in range(len(names))])
    own = F.col(f"__c{names.index(id_col)}").cast("long")
    return inner.join(sent, own == F.col("__lost"), "left_anti").toDF(*names)
