"""Persistence on Parquet tables: keep-latest upserts, claims, and an incremental symbol index.

Parquet has no MERGE, so every change is a function from the tables before and the rows of a batch to the tables after;
writing replaces the partitions concerned. One writer per batch takes the place of locks.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ids import PARSER_VERSION
from ..schemas import TABLES

MAX_ERROR = 4_000
USAGE_COLUMNS = {"tokens_in": "input_tokens", "tokens_out": "output_tokens", "cache_read_tokens": "cache_read_tokens", "cache_write_tokens": "cache_write_tokens"}


def empty(spark, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def _columns(name: str) -> list[str]:
    return [c.strip().split()[0] for c in TABLES[name].replace("map<string,long>", "map").replace("decimal(12,6)", "decimal").split(",")]


def stable_id(*parts: Column) -> Column:
    """A positive bigint made of a row's key: the same wherever and whenever it is made, without a counter to lock."""
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 62) - 1))


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by an order, others dropped: a partial aggregate, no sort of whole groups."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return best.select(*key, *[F.col("__r")[c].alias(c) for c in rest]).select(*rows.columns)


def upsert(table: DataFrame, rows: DataFrame, key: list[str], update: list[str], order: list[str] | None = None) -> DataFrame:
    """The table after inserting rows with new keys and setting the ``update`` columns of the others. Of rows that share a
    key the last by ``order`` counts. Columns that the rows lack are null on insert and kept on update."""
    new = latest(rows, key, order) if order else rows.dropDuplicates(key)
    mine = [c for c in new.columns if c in table.columns and c not in key]
    side = new.select(*[F.col(k).alias(f"__k_{k}") for k in key], *[F.col(c).alias(f"__{c}") for c in mine], F.lit(True).alias("__in"))
    on = [table[k].eqNullSafe(F.col(f"__k_{k}")) for k in key]
    joined = table.withColumn("__had", F.lit(True)).join(side, on, "full_outer")
    had, came = F.col("__had").isNotNull(), F.col("__in").isNotNull()

    def value(c: str) -> Column:
        if c in key:
            return F.coalesce(F.col(c), F.col(f"__k_{c}"))
        if c not in mine:
            return F.col(c)
        return F.when(had & (~came | F.lit(c not in update)), F.col(c)).otherwise(F.col(f"__{c}"))

    return joined.select(*[value(c).cast(table.schema[c].dataType).alias(c) for c in table.columns])


def upsert_repositories(installations: DataFrame, repositories: DataFrame, contexts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after the contexts of a batch: (github_installation_id, account, github_repo_id, full_name, seq). An
    installation is only created; a repository may be renamed or move to another installation."""
    owner = contexts.select(stable_id(F.lit("installation"), F.col("github_installation_id")).alias("id"), "github_installation_id", "account", "seq")
    first = owner.groupBy("github_installation_id").agg(F.min_by(F.struct("id", "account"), "seq").alias("r")).select("r.id", "github_installation_id", "r.account")
    after = upsert(installations, first, ["github_installation_id"], [])
    named = contexts.join(after.select(F.col("id").alias("installation_id"), "github_installation_id"), "github_installation_id")
    rows = named.select(stable_id(F.lit("repository"), F.col("github_repo_id")).alias("id"), "github_repo_id", "full_name", "installation_id", "seq")
    return after, upsert(repositories, rows, ["github_repo_id"], ["full_name", "installation_id"], ["seq"])


def upsert_pull_requests(pull_requests: DataFrame, repositories: DataFrame, contexts: DataFrame) -> DataFrame:
    """The table after (github_repo_id, number, title, head_sha, base_sha, seq)."""
    rows = contexts.join(repositories.select(F.col("id").alias("repo_id"), "github_repo_id"), "github_repo_id")
    rows = rows.select(stable_id(F.lit("pr"), F.col("repo_id"), F.col("number")).alias("id"), "repo_id", "number", "title", "head_sha", "base_sha", F.lit("open").alias("status"), "seq")
    return upsert(pull_requests, rows, ["repo_id", "number"], ["title", "head_sha", "base_sha"], ["seq"])


class Claim(NamedTuple):
    reviews: DataFrame  #: the table after the claims
    candidates: DataFrame  #: the table without what claimed reviews had
    decided: DataFrame  #: (pr_id, head_sha, config_hash, review_id, decision, github_review_id)


def claim_reviews(reviews: DataFrame, candidates: DataFrame, wanted: DataFrame) -> Claim:
    """Claims a review per (pr_id, head_sha, config_hash): ``already_posted`` ones stay as they are, others that exist are
    reset to running and lose their candidates, new ones are inserted.

    wanted: the key and strategy, strategy_config_json, model, prompt_version, started_at. Two rows with one key are one
    claim."""
    key = ["pr_id", "head_sha", "config_hash"]
    once = wanted.dropDuplicates(key)
    known = reviews.select(*key, F.col("id").alias("__id"), F.col("status").alias("__status"), F.col("github_review_id").alias("__posted"))
    seen = once.join(known, key, "left")
    decision = F.when(F.col("__status") == "posted", "already_posted").when(F.col("__id").isNotNull(), "reset").otherwise("new")
    seen = seen.withColumn("decision", decision).withColumn("review_id", F.coalesce("__id", stable_id(F.lit("review"), *[F.col(k) for k in key])))
    decided = seen.select(*key, "review_id", "decision", F.when(F.col("decision") == "already_posted", F.col("__posted")).alias("github_review_id"))
    open_ = seen.filter("decision <> 'already_posted'")
    rows = open_.select(F.col("review_id").alias("id"), *key, "strategy", "strategy_config_json", "model", "prompt_version", "started_at", F.lit("running").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("timestamp_ntz").alias("finished_at"))
    update = ["strategy", "strategy_config_json", "model", "prompt_version", "started_at", "status", "error", "finished_at"]
    after = upsert(reviews, rows, key, update)
    after = after.withColumn("fallback_used", F.coalesce("fallback_used", F.lit(False)))
    left = candidates.join(open_.select("review_id"), "review_id", "left_anti").select(*candidates.columns)
    return Claim(after, left, decided)


def complete_reviews(reviews: DataFrame, candidates: DataFrame, runs: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after a batch of runs. runs: review_id, served_model, fallback_used, prompt_hash, schema_name,
    context_stats_json, redactions, token counts, cost_usd, latency_ms, attempts, request_id, called, finished_at; found:
    candidates of operators.comments.decide with review_id."""
    zero = lambda c: F.when(F.col("called"), F.col(c)).otherwise(F.lit(0))
    rows = runs.select(
        F.col("review_id").alias("id"), F.lit("completed").alias("status"), "served_model", F.coalesce("fallback_used", F.lit(False)).alias("fallback_used"), "prompt_hash", "schema_name", "context_stats_json", "redactions",
        *[zero(c).alias(name) for name, c in USAGE_COLUMNS.items()], zero("cost_usd").cast("decimal(12,6)").alias("cost_usd"),
        F.round(zero("latency_ms")).cast("long").alias("latency_ms"), zero("attempts").cast("int").alias("llm_attempts"), F.col("request_id").alias("llm_request_id"), "finished_at",
    )
    after = upsert(reviews, rows, ["id"], [c for c in rows.columns if c != "id"]).filter("pr_id is not null")
    new = found.select(
        stable_id(F.lit("candidate"), F.col("review_id"), F.col("index")).alias("id"), "review_id", "index", F.col("file").alias("file_path"), "line", "category", "severity", "claim", "evidence", "suggested_fix", "body",
        F.col("confidence").alias("llm_confidence"), F.lit(None).cast("double").alias("filter_score"), "status", "reject_reason", F.col("duplicate_of").alias("duplicate_of_index"), "rank", F.lit(False).alias("posted"),
    )
    return after, candidates.unionByName(new.select(*candidates.columns))


def mark_posted(reviews: DataFrame, candidates: DataFrame, posted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after delivery of (review_id, github_review_id); a null id means that there was nothing to post."""
    rows = posted.select(F.col("review_id").alias("id"), F.lit("posted").alias("status"), "github_review_id")
    after = upsert(reviews, rows, ["id"], ["status", "github_review_id"]).filter("pr_id is not null")
    live = candidates.join(posted.select("review_id", F.lit(True).alias("__live")), "review_id", "left")
    live = live.withColumn("posted", F.col("posted") | (F.coalesce("__live", F.lit(False)) & (F.col("status") == "selected")))
    return after, live.select(*candidates.columns)


def mark_failed(reviews: DataFrame, failed: DataFrame) -> DataFrame:
    """The table after failures (review_id, error, finished_at); long messages are cut."""
    rows = failed.select(F.col("review_id").alias("id"), F.lit("failed").alias("status"), F.substring("error", 1, MAX_ERROR).alias("error"), "finished_at")
    return upsert(reviews, rows, ["id"], ["status", "error", "finished_at"]).filter("pr_id is not null")


class Index(NamedTuple):
    files: DataFrame
    symbols: DataFrame
    edges: DataFrame
    stats: DataFrame  #: per repository: files_kept, files_written, files_deleted, symbols_written, edges


def compare_files(stored: DataFrame, current: DataFrame, version: int = PARSER_VERSION) -> DataFrame:
    """(repo_id, path, id, language, blob_hash, action): keep, write (new or changed) or delete. stored: the files table;
    current: (repo_id, path, language, blob_hash) of what is indexed now. A changed file counts as deleted as well."""
    old = stored.select("repo_id", "path", F.col("id").alias("old_id"), F.col("blob_hash").alias("old_blob"), "parser_version")
    both = old.join(current, ["repo_id", "path"], "full_outer")
    kept = (F.col("old_blob") == F.col("blob_hash")) & (F.col("parser_version") == version)
    action = F.when(F.col("blob_hash").isNull(), "delete").when(F.col("old_id").isNull(), "write").when(kept, "keep").otherwise("rewrite")
    return both.select("repo_id", "path", F.col("old_id"), "language", "blob_hash", action.alias("action"))


def persist_index(files: DataFrame, symbols: DataFrame, edges: DataFrame, repos: DataFrame, indexed: DataFrame, graph_symbols: DataFrame, graph_edges: DataFrame, version: int = PARSER_VERSION) -> Index:
    """The index tables after new snapshots of some repositories.

    repos: (repo_id) that were indexed; indexed: (repo_id, path, language, blob_hash); graph_*: operators.link with repo_id.
    Unchanged files keep their rows and ids; changed and deleted ones lose theirs, with their symbols; edges depend on all
    files, so those of the repositories are replaced. Edges whose ends have no row are dropped.
    """
    mine = files.join(repos, "repo_id", "left_semi")
    actions = compare_files(mine, indexed, version)
    gone = actions.filter("action in ('delete', 'rewrite')").select(F.col("old_id").alias("id"))
    fresh = actions.filter("action in ('write', 'rewrite')").select(
        stable_id(F.lit("file"), F.col("repo_id"), F.col("path"), F.col("blob_hash"), F.lit(version)).alias("id"), "repo_id", "path", "language", "blob_hash", F.lit(version).alias("parser_version")
    )
    after = files.join(gone, "id", "left_anti").select(*files.columns).unionByName(fresh)
    stay = symbols.join(gone.select(F.col("id").alias("file_id")), "file_id", "left_anti").select(*symbols.columns)
    new = graph_symbols.join(fresh.select("repo_id", "path", F.col("id").alias("file_id")), ["repo_id", "path"])
    own = lambda c: stable_id(F.lit("symbol"), F.col("file_id"), c)
    new = new.select(own(F.col("id")).alias("id"), "file_id", F.col("id").alias("local_index"), "name", "qualified_name", "kind", "start_line", "end_line", "signature", "exported", F.when(F.col("parent").isNotNull(), own(F.col("parent"))).alias("parent_symbol_id"))
    all_symbols = stay.unionByName(new)
    ids = graph_symbols.select("repo_id", "path", "gid", F.col("id").alias("local_index")).join(after.select("repo_id", "path", F.col("id").alias("file_id")), ["repo_id", "path"])
    ids = ids.join(all_symbols.select("file_id", "local_index", F.col("id").alias("symbol_id")), ["file_id", "local_index"]).select("repo_id", "gid", "symbol_id")
    linked = graph_edges.join(ids.select("repo_id", F.col("gid").alias("src"), F.col("symbol_id").alias("src_symbol_id")), ["repo_id", "src"])
    linked = linked.join(ids.select("repo_id", F.col("gid").alias("dst"), F.col("symbol_id").alias("dst_symbol_id")), ["repo_id", "dst"])
    linked = linked.select(stable_id(F.lit("edge"), F.col("repo_id"), F.col("src_symbol_id"), F.col("dst_symbol_id"), F.col("kind")).alias("id"), "repo_id", "src_symbol_id", "dst_symbol_id", "kind")
    all_edges = edges.join(repos, "repo_id", "left_anti").select(*edges.columns).unionByName(linked)
    counts = actions.groupBy("repo_id").agg(
        F.count_if(F.col("action") == "keep").alias("files_kept"),
        F.count_if(F.col("action").isin("write", "rewrite")).alias("files_written"),
        F.count_if(F.col("action").isin("delete", "rewrite")).alias("files_deleted"),
    )
    written = new.join(fresh.select(F.col("id").alias("file_id"), "repo_id"), "file_id").groupBy("repo_id").agg(F.count(F.lit(1)).alias("symbols_written"))
    n_edges = linked.groupBy("repo_id").agg(F.count(F.lit(1)).alias("edges"))
    stats = repos.join(counts, "repo_id", "left").join(written, "repo_id", "left").join(n_edges, "repo_id", "left").fillna(0)
    return Index(after, all_symbols, all_edges, stats)


def append_new(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key the table does not have yet, once each: what a content-addressed cache appends."""
    return rows.dropDuplicates(key).join(table.select(*key).distinct(), key, "left_anti")
