"""Walks and counts over symbol graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import relation
from .iterate import checkpoint

# Roles in the order in which they rank at one distance, and the edges followed outwards.
ROLE_RANK = {"enclosing": 0, "callee": 1, "base": 1, "caller": 2}
OUTWARD = ("calls", "extends", "implements")


def walk(starts: DataFrame, edges: DataFrame, depth: int, keys: list[str], graph_keys: list[str], outward: bool = True, start_distance: int = 0, last_places: bool = True) -> DataFrame:
    """Breadth-first from each group of start nodes: (keys, node, distance, kind, pos) for nodes other than the starts.

    starts has (keys, node, pos); a group's nodes are visited once, at their shortest distance, by the first edge that
    reaches them: earlier frontier nodes first, then earlier edges. A round joins the frontier to the edges, drops what
    was visited and keeps one row per node. Frontiers are written between rounds, since each is read twice. Without
    ``last_places`` the nodes of the last round have no pos, which spares a sort and a write of the largest frontier.
    """
    followed = edges.filter(F.col("kind").isin(*OUTWARD) if outward else F.col("kind") == "calls")
    here, other = ("src", "dst") if outward else ("dst", "src")
    steps = followed.select(*graph_keys, F.col(here).alias("node"), F.col(other).alias("next"), "kind", "seq")
    frontier = starts.groupBy(*keys, "node").agg(F.min("pos").alias("pos"))
    seen, out = frontier.select(*keys, "node"), None
    for distance in range(start_distance + 1, depth + 1):
        offered = frontier.join(steps, [*graph_keys, "node"]).select(*keys, F.col("next").alias("node"), "kind", F.struct("pos", "seq").alias("at"))
        fresh = offered.groupBy(*keys, "node").agg(F.min("at").alias("at"), F.min_by("kind", "at").alias("kind")).join(seen, [*keys, "node"], "left_anti")
        if distance == depth and not last_places:
            rest = fresh.select(*keys, "node", F.lit(distance).alias("distance"), "kind", F.lit(None).cast("long").alias("pos"))
            return rest if out is None else out.unionByName(rest)
        order = W.partitionBy(*keys).orderBy("at")
        found = checkpoint(fresh.select(*keys, "node", F.lit(distance).alias("distance"), "kind", F.row_number().over(order).cast("long").alias("pos")))
        out = found if out is None else out.unionByName(found)
        if distance == depth or found.isEmpty():
            break
        seen = seen.unionByName(found.select(*keys, "node"))
        frontier = found.select(*keys, "node", "pos")
    if out is None:
        return starts.select(*keys, "node", F.lit(0).alias("distance"), F.lit("").alias("kind"), "pos").filter("false")
    return out


def in_degree(symbols: DataFrame, edges: DataFrame, keys: list[str], kind: str = "calls") -> DataFrame:
    """(keys, gid, n): incoming edges of a kind for every symbol but modules, zeros included."""
    counts = edges.filter(F.col("kind") == kind).groupBy(*keys, F.col("dst").alias("gid")).agg(F.count(F.lit(1)).alias("n"))
    return symbols.filter("kind <> 'module'").select(*keys, "gid").join(counts, [*keys, "gid"], "left").fillna(0, ["n"])


def most_called(symbols: DataFrame, edges: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    """The k symbols of each repository with most callers, ties by id: a rank limit before and after the shuffle."""
    ranked = in_degree(symbols, edges, keys).withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), "gid")))
    return ranked.filter(F.col("rank") <= k)


def kind_histogram(symbols: DataFrame, keys: list[str]) -> DataFrame:
    return symbols.groupBy(*keys, "kind").agg(F.count(F.lit(1)).alias("n"))


def calls_on_lines(sites: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Resolved call sites that stand on given (keys, path, line)."""
    return sites.join(lines.select(*keys, "path", "line").distinct(), [*keys, "path", "line"], "left_semi")


def best_offers(offers: DataFrame, keys: list[str]) -> DataFrame:
    """One candidate per symbol: least distance, then role, then first offered; fan_in counts the seeds that reach it.

    offers: (keys, gid, role, distance, seed, order, ...); order is a struct that sorts offers by time."""
    rank = F.create_map(*[F.lit(x) for pair in ROLE_RANK.items() for x in pair])[F.col("role")]
    rest = [c for c in offers.columns if c not in (*keys, "gid")]
    best = offers.groupBy(*keys, "gid").agg(F.min_by(F.struct(*rest), F.struct("distance", rank.alias("rank"), "order")).alias("b"), F.countDistinct("seed").alias("fan_in"))
    return best.select(*keys, "gid", *[F.col("b")[c].alias(c) for c in rest], "fan_in")


def rank_candidates(changed: DataFrame, symbols: DataFrame, edges: DataFrame, sites: DataFrame, callee_depth: int, caller_depth: int, keys: list[str], graph_keys: list[str]) -> DataFrame:
    """Symbols around the changed ones, in the order in which they enter a context.

    changed: (keys, gid, path, qualified_name, kind, lines); keys start with graph_keys. Changed symbols come first at
    distance 0; then what they call or extend up to callee_depth and what calls them up to caller_depth. A changed module
    follows only the calls on its changed lines. Modules are passed through but never offered. Order: distance, role,
    fan_in descending, path, start, id.
    """
    by = [*keys, "seed"]
    seeds = changed.withColumn("seed", F.col("gid"))
    named = seeds.select(*keys, "seed", F.col("qualified_name").alias("related_to"))
    own = seeds.filter("kind <> 'module'")
    shape = lambda df, part: df.withColumn("order", F.struct(F.col("seed"), F.lit(part).alias("part"), F.col("distance"), F.col("pos")))
    enclosing = own.select(*by, "gid", F.lit("enclosing").alias("role"), F.lit(0).alias("distance"), F.lit(0).cast("long").alias("pos"), F.col("lines").alias("focus"))
    none = F.lit(None).cast("array<int>").alias("focus")
    role = F.when(F.col("kind") == "calls", "callee").otherwise("base").alias("role")
    starts = own.select(*by, F.col("gid").alias("node"), F.lit(0).cast("long").alias("pos"))
    parts = [shape(enclosing, 0)]
    if callee_depth >= 1:
        out = walk(starts, edges, callee_depth, by, graph_keys)
        parts.append(shape(out.select(*by, F.col("node").alias("gid"), role, "distance", "pos", none), 1))
        spots = seeds.filter("kind = 'module'").select(*by, "path", F.explode("lines").alias("line"))
        direct = sites.join(spots, [*graph_keys, "path", "line"]).select(*by, F.col("dst").alias("node"), F.col("seq").cast("long").alias("pos"))
        direct = checkpoint(direct.groupBy(*by, "node").agg(F.min("pos").alias("pos")))
        parts.append(shape(direct.select(*by, F.col("node").alias("gid"), F.lit("callee").alias("role"), F.lit(1).alias("distance"), "pos", none), 0))
        more = walk(direct, edges, callee_depth, by, graph_keys, start_distance=1)
        parts.append(shape(more.select(*by, F.col("node").alias("gid"), role, "distance", "pos", none), 1))
    if caller_depth >= 1:
        back = walk(starts, edges, caller_depth, by, graph_keys, outward=False)
        parts.append(shape(back.select(*by, F.col("node").alias("gid"), F.lit("caller").alias("role"), "distance", "pos", none), 2))
    offers = parts[0]
    for part in parts[1:]:
        offers = offers.unionByName(part)
    facts = symbols.select(*graph_keys, "gid", "path", "qualified_name", "kind", "start_line", "end_line", "signature")
    offers = offers.join(facts.filter("kind <> 'module'"), [*graph_keys, "gid"])
    best = best_offers(offers, keys).join(named, by)
    rank = F.create_map(*[F.lit(x) for pair in ROLE_RANK.items() for x in pair])[F.col("role")]
    order = W.partitionBy(*keys).orderBy("distance", rank, F.desc("fan_in"), "path", "start_line", "gid")
    best = best.withColumn("seq", F.row_number().over(order) - 1).withColumn("relation", relation(F.col("role"), F.col("related_to"), F.col("distance")))
    return best.drop("order", "pos")
