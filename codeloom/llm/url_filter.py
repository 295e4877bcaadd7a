"""Judges URLs by host and path rules, and by boosted trees on lexical features where no rule fits."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, pick

#: Labelled URLs that the trees are fitted on at most, drawn by their hash, so that the sample doesn't depend on partitions.
SAMPLE = 50_000
ROUNDS, DEPTH, BINS, RATE = 40, 3, 32, 0.2


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule (verdict, "host/path") that fits, or null."""
    out = None
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        cut = rule.index("/")
        fits = ((host == rule[:cut]) | host.endswith("." + rule[:cut])) & path.startswith(rule[cut:])
        out = F.when(fits, F.lit(rule)) if out is None else out.when(fits, F.lit(rule))
    return F.lit(None).cast("string") if out is None else out


class Suffixes(NamedTuple):
    """Smoothed share of blocked URLs and number of labelled URLs by the last label and the last two labels of the host."""

    prior: float
    stats: dict


_LOWERED = str.maketrans(UPPER, LOWER)


def _suffixes(url: str) -> tuple[str, str, str]:
    rest = url.partition("://")[2]
    host = rest
    for c in "/?#":
        host = host.partition(c)[0]
    labels = host.translate(_LOWERED).split(".")
    return host, labels[-1], ".".join(labels[-2:])


def suffix_statistics(urls: list[str], y: np.ndarray) -> Suffixes:
    seen: dict = defaultdict(lambda: [0, 0.0])
    for url, label in zip(urls, y, strict=True):
        for k in set(_suffixes(url)[1:]):
            seen[k][0] += 1
            seen[k][1] += label
    prior = float(np.mean(y)) if len(y) else 0.0
    return Suffixes(prior, {k: ((b + 10 * prior) / (n + 10), math.log1p(n)) for k, (n, b) in seen.items()})


def features(urls: list[str], suffixes: Suffixes) -> np.ndarray:
    """One row of lexical features per URL."""
    out = np.zeros((len(urls), 18))
    for row, url in zip(out, urls, strict=True):
        host, top, two = _suffixes(url)
        tail = url.partition("://")[2][len(host) :]
        path, _, query = tail.partition("#")[0].partition("?")
        counts = Counter(url)
        n = max(1, len(url))
        segments = [s for s in path.split("/") if s]
        digits = sum(map(str.isdigit, url))
        rate1, seen1 = suffixes.stats.get(top, (suffixes.prior, 0.0))
        rate2, seen2 = suffixes.stats.get(two, (suffixes.prior, 0.0))
        row[:] = (
            len(url), len(host), len(path), len(segments), host.count("."), digits / n, sum(map(str.isdigit, host)) / max(1, len(host)),
            -sum(c / n * math.log2(c / n) for c in counts.values()), sum(map(bool, query.split("&"))), len(query), url.count("-"), host.count("-"),
            max(map(len, segments), default=0), url.startswith("https"), rate1, seen1, rate2, seen2,
        )
    return out


class Trees(NamedTuple):
    """Boosted trees of one depth: cut feature and value of each inner node, score of each leaf, by tree."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows, depth = np.arange(len(x)), int(math.log2(self.leaf.shape[1])) if self.leaf.size else 0
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), int)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (len(leaf) - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE, ridge: float = 1.0) -> Trees:
    """Logistic boosting with histogram splits: each level sums gradients by node, feature and bin at once."""
    n_inner, n_leaf = 2**depth - 1, 2**depth
    mean = min(max(float(np.mean(y)) if len(y) else 0.0, 1e-4), 1 - 1e-4)
    base = math.log(mean / (1 - mean))
    if len(y) == 0 or y.min() == y.max():
        return Trees(base, np.zeros((0, n_inner), int), np.zeros((0, n_inner)), np.zeros((0, n_leaf)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    n, f = x.shape
    margin, trees = np.full(n, base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node, feature, cut = np.zeros(n, int), np.zeros(n_inner, int), np.full(n_inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            flat = (((node - first)[:, None] * f + np.arange(f)) * BINS + binned).ravel()
            size = width * f * BINS
            sums = [np.cumsum(np.bincount(flat, np.repeat(v, f), size).reshape(width, f, BINS), axis=2) for v in (g, h)]
            all_g, all_h = sums[0][:, :, -1:], sums[1][:, :, -1:]
            gain = sums[0] ** 2 / (sums[1] + ridge) + (all_g - sums[0]) ** 2 / (all_h - sums[1] + ridge) - all_g**2 / (all_h + ridge)
            for k in range(width):
                i, b = np.unravel_index(np.argmax(np.round(gain[k, :, :-1], 9)), (f, BINS - 1))
                if gain[k, i, b] > 1e-6 and b < len(edges[i]):
                    feature[first + k], cut[first + k] = i, edges[i][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        at = node - n_inner
        leaf = rate * np.bincount(at, g, n_leaf) / (np.bincount(at, h, n_leaf) + ridge)
        margin += leaf[at]
        trees.append((feature, cut, leaf))
    return Trees(base, *(np.array(t) for t in zip(*trees, strict=True)))


def train(urls: list[str], y: np.ndarray) -> tuple[Trees, Suffixes]:
    """Trees on features whose suffix statistics come from the other half of the sample, so that no URL sees its own label."""
    y = np.asarray(y, float)
    half = np.arange(len(urls)) % 2
    x = np.zeros((len(urls), 18))
    for k in (0, 1):
        mine, other = np.flatnonzero(half == k), np.flatnonzero(half != k)
        x[mine] = features([urls[i] for i in mine], suffix_statistics([urls[i] for i in other], y[other]))
    return fit_trees(x, y), suffix_statistics(urls, y)


def url_filter(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", sample: int = SAMPLE) -> DataFrame:
    """Per row (id, host, path, rule, verdict, score): score is the trees' probability of "block".

    A rule's verdict stands; other URLs are blocked at a score of 0.5. URLs that a rule fits are the labels; at most
    ``sample`` of them train the model. Null URLs and URLs without ``://`` have an empty host and path. With no label, or
    labels of one kind, the score is their smoothed share, so nothing is blocked without a label. Rows are kept as they
    come, repeats included.
    """
    pages = pick(pages, id_col, url_col).toDF("__id", "url")
    judged = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    judged = judged.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    blocked = [r for v, r in rules if v == "block"]
    labelled = judged.filter("rule is not null").select("url", F.col("rule").isin(blocked).cast("int").alias("y"))
    # tasks send their share of the sample, not as much as the whole of it
    n = labelled.count()
    part = F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < int(min(1.0, sample / max(1, n)) * (1 << 30))
    rows = labelled.filter(part).distinct().orderBy(F.xxhash64("url"), "url").limit(sample).collect()
    model = train([r["url"] for r in rows], np.array([r["y"] for r in rows], float))
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trees, suffixes = sent.value
        for urls in parts:
            yield pd.Series(1 / (1 + np.exp(-trees.margin(features([u or "" for u in urls], suffixes)))), dtype="float64")

    score.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    scored = judged.withColumn("score", F.pandas_udf(score, "double")("url"))
    verdict = F.when(F.col("rule").isin(blocked), "block").when(F.col("rule").isNotNull(), "allow").when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select(F.col("__id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score")
