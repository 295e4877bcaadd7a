"""Reviews of many changes in one job: scrub, parse, context, model, checks, ranking."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import blob_sha, parse_cache_key, stable_json
from ..functions.scrub import redaction_totals, scrubbed
from ..functions.text import omitted_note, review_body, template_column, trim
from ..operators import comments as c
from ..operators import context, diff, extract, graph, link, model_calls, ranges
from ..operators.iterate import checkpoint, stored
from ..sources.settings import Prompt, Strategy, load_prompt

PROMPTS = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "prompts")
KEYS = ["repo_id", "sha", "review_id"]
GRAPH = ["repo_id", "sha"]


class IndexRun(NamedTuple):
    parses: DataFrame  #: (repo_id, sha, path, language, blob_sha, parse)
    new_parses: DataFrame  #: (key, parse) to append to the cache
    stats: DataFrame  #: per repository: files_listed, files_indexed, parsed, from_cache, unreadable


def index_files(files: DataFrame, cache: DataFrame | None = None, keys: list[str] | None = None) -> IndexRun:
    """Parses the indexable files of snapshots (keys, path, blob_sha, size, content).

    A blob is parsed once under the parser's version: keys that the cache has are joined to it, and rows of the other keys
    meet in one task, key by key, where the first is read and the rest take its parse. Missing or too large contents are left
    out and counted.
    """
    keys = keys or GRAPH
    listed = files.groupBy(*keys).agg(F.count(F.lit(1)).alias("files_listed"))
    own = files.filter(context.is_indexable(F.col("path"), F.col("size"))).withColumn("language", extract.language_of(F.col("path")))
    own = own.withColumn("key", parse_cache_key(F.col("language"), F.col("blob_sha"))).select(*keys, "path", "language", "blob_sha", "key", "content")
    cached = None
    if cache is not None:
        known = cache.filter("parse is not null")
        cached = own.drop("content").join(known.select("key", "parse"), "key")
        own = own.join(known.select("key"), "key", "left_anti")
    readable = F.col("content").isNotNull() & (F.char_length("content") <= context.MAX_INDEXED)
    own = own.withColumn("content", F.when(readable, F.col("content"))).repartition("key").sortWithinPartitions("key")
    rows = own.select(*keys, "path", "language", "blob_sha", "key", F.when(F.col("content").isNull(), "unreadable").otherwise("parsed").alias("state"), extract.parsed(F.col("content"), F.col("language")).alias("parse"))
    if cached is not None:
        rows = rows.unionByName(cached.withColumn("state", F.lit("cached")))
    rows = stored(rows, "parses")
    parses = rows.filter("state <> 'unreadable'").select(*keys, "path", "language", "blob_sha", "parse")
    fresh = rows.filter("state = 'parsed'").select("key", "parse").dropDuplicates(["key"])
    counts = rows.groupBy(*keys).agg(
        F.count_if(F.col("state") != "unreadable").alias("files_indexed"),
        F.count_if(F.col("state") == "parsed").alias("parsed"),
        F.count_if(F.col("state") == "cached").alias("from_cache"),
        F.count_if(F.col("state") == "unreadable").alias("unreadable"),
    )
    return IndexRun(parses, fresh, listed.join(counts, keys, "left").fillna(0))


class ReviewRun(NamedTuple):
    reviews: DataFrame  #: a row per review: context statistics, redactions, call summary
    sections: DataFrame  #: what each prompt shows
    candidates: DataFrame  #: every comment with its decision
    selected: DataFrame  #: comments to post, in rank order
    calls: DataFrame  #: call records
    cache_rows: DataFrame  #: answers to keep
    index: IndexRun | None


def run_reviews(changes: DataFrame, files: DataFrame, config: Strategy, make_provider: Callable[[], model_calls.Provider] = model_calls.FakeProvider, answers: DataFrame | None = None, parses: DataFrame | None = None, salt: str | None = None, prompts: str = PROMPTS) -> ReviewRun:
    """Reviews changes (repo_id, sha, review_id, title, body, diff) against snapshots (repo_id, sha, path, blob_sha, size,
    content) under one strategy.

    The result depends on these tables, the strategy and the answers alone. Secrets are replaced before anything else, in
    diffs, files and descriptions. Changes without reviewable files, or whose diffs all miss the budget, make no call and
    have no comments.
    """
    provider = make_provider()
    if provider.name not in (config.provider, "fake"):
        raise ValueError(f"the strategy expects provider {config.provider}, not {provider.name}")
    prompt = load_prompt(prompts, config.prompt_version)
    clean = scrubbed(changes.select(*KEYS, "diff"), "diff", diff=True, counts_as="r")
    found = checkpoint(context.is_reviewable(diff.diff_files(clean, keys=tuple(KEYS))))
    wanted = found.select(*KEYS, F.col("new_path").alias("path")).distinct()
    read = files.select(*GRAPH, "path", F.when(F.char_length("content") <= 1_000_000, F.col("content")).alias("content"))
    changed_heads = wanted.join(read, [*GRAPH, "path"], "left")
    heads = checkpoint(scrubbed(changed_heads.filter("content is not null"), "content", counts_as="r"))

    reviews = changes.select(*KEYS).withColumn("strategy", F.lit(config.strategy)).withColumn("budget", F.lit(config.context_token_budget))
    pieces = checkpoint(context.base_context(found, heads.drop("r"), reviews, KEYS))
    stats = checkpoint(context.context_stats(pieces, KEYS))
    shown = pieces.filter("taken").select(*KEYS, "kind", "path", "text", "tokens", F.struct(F.lit(0).alias("part"), F.col("seq").cast("int").alias("seq")).alias("at"))
    index, extra, extra_redactions = None, None, None
    if config.uses_graph:
        index, extra, extra_redactions = _symbols(changes, files, read, found, pieces, stats, heads, config, parses)
        shown = shown.unionByName(extra.filter("mode is not null").select(*KEYS, F.lit("symbol").alias("kind"), "path", "text", "tokens", F.struct(F.lit(1).alias("part"), F.col("seq").cast("int").alias("seq")).alias("at")))
    shown = checkpoint(shown)

    described = scrubbed(changes.select(*KEYS, F.coalesce("title", F.lit("")).alias("title")), "title", counts_as="r1")
    bodies = trim(F.coalesce("body", F.lit("")))
    described = described.join(scrubbed(changes.select(*KEYS, F.when(bodies == "", "(no description)").otherwise(bodies).alias("body")), "body", counts_as="r2"), KEYS)
    whole = shown.groupBy(*KEYS).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n\n").alias("context"))
    asked = whole.join(described, KEYS).join(stats, KEYS)
    asked = asked.withColumn("prompt", template_column(prompt.user, {"title": F.col("title"), "description": F.col("body"), "context": F.col("context"), "notes": omitted_note(F.col("diffs_omitted"))}))
    requests = asked.select(
        *KEYS, F.lit(config.model).alias("model"), F.lit(prompt.system).alias("system"), "prompt", F.lit(c.SCHEMA_NAME).alias("schema_name"), F.lit(config.max_output_tokens).alias("max_output_tokens"),
        F.lit(config.effort).alias("effort"), F.lit(config.refusal_fallback).alias("refusal_fallback"), F.lit(salt).cast("string").alias("cache_salt"),
    )
    results = checkpoint(model_calls.call_model(requests, answers, make_provider))

    lines = diff.diff_lines(found, tuple(KEYS))
    said = model_calls.comments_of(results, KEYS)
    candidates = checkpoint(c.decide(c.validate(said, lines, heads.drop("r"), KEYS), F.lit(config.max_comments), KEYS))
    kinds = [clean.select(*KEYS, "r"), heads.select(*KEYS, "r"), described.join(whole.select(*KEYS), KEYS, "left_semi").select(*KEYS, F.col("r1").alias("r")), described.join(whole.select(*KEYS), KEYS, "left_semi").select(*KEYS, F.col("r2").alias("r"))]
    if extra_redactions is not None:
        kinds.append(extra_redactions)
    every = kinds[0]
    for k in kinds[1:]:
        every = every.unionByName(k)
    redactions = redaction_totals(every.withColumnRenamed("r", "redactions"), KEYS)
    summary = _summary(changes, prompt, config, stats, extra, redactions, results)
    return ReviewRun(summary, shown, candidates, c.selected(candidates, KEYS), model_calls.call_records(results), model_calls.cache_rows(results), index)


def _symbols(changes, files, read, found, pieces, stats, heads, config, parses):
    """The symbol sections of each review, from what its diffs left of the budget."""
    needed = changes.select(*GRAPH).distinct()
    index = index_files(files.join(needed, GRAPH, "left_semi"), parses)
    g = link.kept(link.link(index.parses.select(*GRAPH, "path", "parse"), GRAPH))
    included = pieces.filter("taken and kind = 'diff'").select(*KEYS, F.col("path").alias("new_path"))
    lines = diff.diff_lines(found.join(included, [*KEYS, "new_path"], "left_semi"), tuple(KEYS))
    changed = checkpoint(ranges.changed_symbols(lines, g.symbols, KEYS, GRAPH))
    near = checkpoint(graph.rank_candidates(changed, g.symbols, g.edges, g.call_sites, *config.depths, KEYS, GRAPH))
    others = near.select(*KEYS, "path").distinct().join(heads.select(*KEYS, "path"), [*KEYS, "path"], "left_anti").join(read, [*GRAPH, "path"])
    more = checkpoint(scrubbed(others.filter("content is not null"), "content", counts_as="r"))
    views = context.symbol_views(near, heads.drop("r").unionByName(more.drop("r").select(*heads.drop("r").columns)), KEYS)
    limits = stats.select(*KEYS, (F.lit(config.context_token_budget) - F.col("estimated_tokens")).cast("int").alias("remaining"), F.lit(config.max_symbol_tokens).alias("max_symbol_tokens"))
    return index, checkpoint(context.assemble(views, limits, KEYS)), more.select(*KEYS, "r")


def _summary(changes, prompt: Prompt, config: Strategy, stats, extra, redactions, results) -> DataFrame:
    out = changes.select(*KEYS).join(stats, KEYS, "left").join(redactions, KEYS, "left")
    if extra is not None:
        out = out.join(context.assembly_stats(extra, KEYS).select(*KEYS, "included", "signature_only", "omitted", F.col("tokens").alias("symbol_tokens")), KEYS, "left")
        out = out.withColumn("estimated_tokens", F.coalesce("estimated_tokens", F.lit(0)) + F.coalesce("symbol_tokens", F.lit(0)))
    called = results.select(*KEYS, F.lit(True).alias("called"), "provider", "requested_model", "served_model", "fallback_used", *model_calls.USAGE, "cost_usd", "latency_ms", "attempts", "cached", "request_id", "error_kind", "error")
    facts = {"strategy": config.strategy, "strategy_config_json": stable_json(config.fields()), "config_hash": config.hash, "prompt_version": prompt.version, "prompt_hash": prompt.content_hash, "schema_name": c.SCHEMA_NAME}
    out = out.join(called, KEYS, "left").withColumn("called", F.coalesce("called", F.lit(False)))
    return out.withColumns({k: F.lit(v) for k, v in facts.items()})


def posts(run: ReviewRun, name: str) -> DataFrame:
    """What is delivered: one row per review with comments to post, its summary text and its comments in order. Keyed by
    review, so delivering it again replaces it."""
    each = run.selected.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("seq", F.col("file").alias("path"), "line", F.lit("RIGHT").alias("side"), "body"))).alias("comments"))
    told = each.join(run.reviews.select(*KEYS, "strategy", F.coalesce("served_model", "requested_model").alias("model")), KEYS)
    return told.withColumn("body", review_body(name, F.size("comments"), F.col("strategy"), F.col("model"))).drop("strategy", "model")


def report(index: IndexRun, g: link.Graph, keys: list[str] | None = None) -> DataFrame:
    """A JSON report per repository: index and graph counts, kinds of symbols, the ten most called."""
    keys = keys or GRAPH
    kinds = graph.kind_histogram(g.symbols, keys).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("symbol_kinds"))
    top = graph.most_called(g.symbols, g.edges, keys).join(g.symbols.select(*keys, "gid", "path", "qualified_name"), [*keys, "gid"])
    said = F.concat(F.col("path"), F.lit(":"), F.col("qualified_name"), F.lit(" ("), F.col("n").cast("string"), F.lit(" callers)"))
    top = top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", said.alias("said")))), lambda x: x["said"]).alias("most_called"))
    out = index.stats.join(g.stats, keys, "left").join(kinds, keys, "left").join(top, keys, "left")
    return out.select(*keys, F.to_json(F.struct(*[x for x in out.columns if x not in keys])).alias("report"))


def as_json(rows: list) -> str:
    return json.dumps([r.asDict(recursive=True) for r in rows], indent=2, default=str)
