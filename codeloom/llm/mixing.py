"""Mixes sources to target weights by pivotal dependent rounding over a reduction tree."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, pick
from .textscan import NOT_SPACE, steps, words

#: Documents in a leaf of the tree, on average, and residuals that one inner node combines.
LEAF, FAN_IN = 2_000, 64
#: Sources whose totals the driver solves for; weights by turns are for a list that somebody wrote. More are an error, not cut.
MOST_SOURCES = 1_000_000
#: Rows of the plan that are sent to the tasks; a longer one is joined.
SENT_SOURCES = 100_000


def word_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h1, h2) of columns (doc_id, source, text, h1, h2): size is the number of white-space-separated
    words."""

    def run(batches):
        for batch in batches:
            counts = [words(s, NOT_SPACE).counts for s in steps(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(counts) if counts else [], pa.int64()), batch.column(3), batch.column(4)], names=["doc_id", "source", "size", "h1", "h2"])

    return docs.mapInArrow(run, "doc_id long, source string, size long, h1 long, h2 long")


def water_fill(sizes: list[float], weights: list[float], share: float, most: float) -> list[float]:
    """Targets that share ``share`` of all sizes by weight, each at most ``most`` times its size; what is above goes to the
    others. Sources fill up in the order of size over weight, so one pass over that order finds all that are full."""
    some = sorted((i for i, s in enumerate(sizes) if s > 0), key=lambda i: (sizes[i] / weights[i], i))
    left, weight, full = share * sum(sizes), sum(weights[i] for i in some), 0
    while full < len(some) and left * weights[some[full]] / weight > most * sizes[some[full]]:
        left, weight, full = left - most * sizes[some[full]], weight - weights[some[full]], full + 1
    # summed anew in the order of the sources, so that targets don't depend on the order above
    filled, open_ = sorted(some[:full]), sorted(some[full:])
    left, weight = share * sum(sizes) - sum(most * sizes[i] for i in filled), sum(weights[i] for i in open_)
    targets = dict.fromkeys(range(len(sizes)), 0.0) | {i: float(most * sizes[i]) for i in filled} | {i: left * weights[i] / weight for i in open_}
    return list(targets.values())


def pivot(sizes: np.ndarray, parts: np.ndarray, seed: list[int]) -> tuple[np.ndarray, int, float]:
    """Rounds fractional parts to 0 or 1 and keeps the sum of size * part: of two open items, one random transfer of mass
    makes at least one integral, each part keeping its expectation. Returns the rounded parts, the position of the item
    that is still open (-1: none) and its part."""
    out = np.zeros(len(parts), np.int64)
    draws = np.random.Generator(np.random.Philox(np.random.SeedSequence(seed))).random(len(parts))
    j, q = -1, 0.0
    for i in range(len(parts)):
        p, s = float(parts[i]), float(sizes[i])
        if p <= 1e-12 or s <= 0:
            continue
        if p >= 1 - 1e-12:
            out[i] = 1
            continue
        if j < 0:
            j, q = i, p
            continue
        t = float(sizes[j])
        up, down = min((1 - q) * t, p * s), min(q * t, (1 - p) * s)
        if draws[i] * (up + down) < down:
            q, p = q + up / t, p - up / s
        else:
            q, p = q - down / t, p + down / s
        shut_j, shut_i = q <= 1e-9 or q >= 1 - 1e-9, p <= 1e-9 or p >= 1 - 1e-9
        if shut_j:
            out[j] = round(q)
            j, q = -1, 0.0
        if shut_i:
            out[i] = round(p)
        elif j < 0:
            j, q = i, p
    return out, j, q


def _node(seed: int, level: int, last: bool):
    """An inner node: rounds the residuals that meet in it; the root draws for the one that is left."""

    def node(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("leaf", kind="stable").reset_index(drop=True)
        rank, at = int(pdf["rank"].iloc[0]), int(pdf["node"].iloc[0])
        out, j, q = pivot(pdf["size"].to_numpy(), pdf["part"].to_numpy(), [seed, rank, at, level])
        part = np.zeros(len(pdf))
        if j >= 0 and last:
            out[j] = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, rank, at, level, 1]))).random() < q
        elif j >= 0:
            part[j] = q
        return pdf.assign(extra=out, part=part)[["rank", "leaf", "node", "size", "part", "extra"]]

    return node


def rounded(docs: DataFrame, weights, share: float, most: float, seed: int) -> DataFrame:
    """For columns (doc_id, source, text, h1, h2), rows alike taken as one: (doc_id, source, size, h1, h2, m, source_size,
    target, whole, extra). Each of the m rows has ``whole`` copies, ``extra`` of them one more."""
    spark = docs.sparkSession
    alike = ["doc_id", "source", "size", "h1", "h2"]
    counted = checkpoint(word_counts(docs).groupBy(*alike).agg(F.count(F.lit(1)).alias("m")))
    totals = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("size"), F.count(F.lit(1)).alias("n"))
    rows = totals.limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources")
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    targets = water_fill([r["size"] for r in rows], [weights[i % len(weights)] for i in range(len(rows))], share, most)
    plan = spark.createDataFrame(
        [(i, r["source"], int(r["size"]), float(t), t / r["size"] if r["size"] else 0.0, -(-r["n"] // LEAF)) for i, (r, t) in enumerate(zip(rows, targets, strict=True))],
        "rank int, __source string, source_size long, target double, rate double, leaves long",
    )
    known = counted.join(F.broadcast(plan) if len(rows) <= SENT_SOURCES else plan, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    known = known.withColumn("leaf", F.pmod(F.xxhash64(*alike), F.col("leaves")))

    def leaf(pdf: pd.DataFrame) -> pd.DataFrame:
        # largest first: what stays open at the end then tends to be small
        pdf = pdf.sort_values(["size", "doc_id", "h1", "h2"], ascending=[False, True, True, True], kind="stable", na_position="last").reset_index(drop=True)
        whole = np.floor(pdf["rate"].to_numpy() + 1e-12)
        due = pdf["m"].to_numpy() * np.maximum(0.0, pdf["rate"].to_numpy() - whole)  # of m rows alike so many have one copy more
        sure = np.floor(due + 1e-12)
        out, j, q = pivot(pdf["size"].to_numpy(), due - sure, [seed, int(pdf["rank"].iloc[0]), int(pdf["leaf"].iloc[0]), 0])
        part = np.zeros(len(pdf))
        if j >= 0:
            part[j] = q
        return pdf.assign(whole=whole.astype("int64"), extra=(sure + out).astype("int64"), part=part)[[*alike, "m", "source_size", "target", "rank", "leaf", "whole", "extra", "part"]]

    schema = "doc_id long, source string, size long, h1 long, h2 long, m long, source_size long, target double, rank int, leaf long, whole long, extra long, part double"
    done = checkpoint(known.groupBy("rank", "leaf").applyInPandas(leaf, schema))
    open_, level, settled = done.filter("part > 0").select("rank", "leaf", F.col("leaf").alias("node"), "size", "part"), 0, None
    deepest = max([r["n"] // LEAF + 1 for r in rows], default=1)
    while True:
        level += 1
        last = deepest <= 1
        if not last:
            open_ = open_.withColumn("node", F.expr(f"node div {FAN_IN}"))
            deepest = -(-deepest // FAN_IN)
        combined = checkpoint(open_.groupBy("rank", "node").applyInPandas(_node(seed, level, last), "rank int, leaf long, node long, size long, part double, extra long"))
        closed = combined.filter("part = 0").select("rank", "leaf", F.col("extra").alias("one"))
        settled = closed if settled is None else settled.unionByName(closed)
        open_ = combined.filter("part > 0").drop("extra")
        if last:
            break
    more = F.when(F.col("part") > 0, F.coalesce("one", F.lit(0))).otherwise(0)
    return done.join(settled, ["rank", "leaf"], "left").select(*alike, "m", "source_size", "target", "whole", (F.col("extra") + more).alias("extra"))


def _columns(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return pick(docs, id_col, source_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document (id, source, size, source_size, target, copies, taken).

    Sources in code point order, null last, take ``weights`` in turn. Each document's copies have the same expectation
    within a source, target / source_size; the whole part is given and the fraction rounded by pivots that keep the sum
    of words, so a source's taken words miss its target by less than its last open document. Leaves are cut by a hash of
    the row and sorted, and draws are seeded by leaf, so the result depends on the rows alone. A hot source has more
    leaves; a leaf sends one residual on, and inner nodes combine 64. Sizes of 0, null texts among them, take 0. Rows alike
    in id, source and text are counted first and rounded as one, so that a leaf has some thousand rows whatever repeats.
    Null ids are ids like others. An empty table gives no rows.
    """
    rows = rounded(_columns(docs, id_col, text_col, source_col), weights, share, most, seed)
    each = rows.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("m"))))
    copies = F.col("whole") + (F.col("__i") <= F.col("extra")).cast("long")
    return each.select(F.col("doc_id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def drawn(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", copy_col: str = "copy") -> DataFrame:
    """The mix itself: every document as often as mix() gives it copies, with a column ``copy_col`` that numbers them from 1
    (an integer; a column of that name, in any case, is replaced). Documents without copies or words go. Of rows alike in id,
    source and text one stands for all, with the copies of all. An empty table gives no rows."""
    names = docs.columns
    inner = docs.toDF(*[f"__c{i}" for i in range(len(names))])
    own, text, source = (F.col(f"__c{names.index(c)}") for c in (id_col, text_col, source_col))
    body = F.coalesce(text, F.lit(""))
    keyed = inner.withColumns({"__id": own.cast("long"), "__s": source.cast("string"), "__h1": F.xxhash64(body), "__h2": F.xxhash64(F.lit(1), body)})
    given = checkpoint(rounded(_columns(docs, id_col, text_col, source_col), weights, share, most, seed).filter("size > 0").select("doc_id", "source", "h1", "h2", "m", (F.col("whole") * F.col("m") + F.col("extra")).cast("int").alias("__copies")))
    if given.filter("m > 1").take(1):
        keyed = keyed.dropDuplicates(["__id", "__s", "__h1", "__h2"])
    same = F.col("__id").eqNullSafe(F.col("doc_id")) & F.col("__s").eqNullSafe(F.col("source")) & (F.col("__h1") == F.col("h1")) & (F.col("__h2") == F.col("h2"))
    held = keyed.join(given.filter("__copies > 0"), same).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return held.select(*[F.col(f"__c{i}").alias(n) for i, n in enumerate(names) if n.lower() != copy_col.lower()], F.col("__copy").alias(copy_col))
