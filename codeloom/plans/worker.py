"""Jobs to posted reviews and stored indexes: what a consumer of the job streams does with a batch."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import stable_json
from ..operators import link, model_calls, store
from ..operators.iterate import checkpoint
from ..sources.settings import Strategy
from ..streaming import ingest
from . import review

# Answers of the remote side after which trying again is of no use.
FINAL_STATUSES = (401, 404, 422)


class Unrecoverable(Exception):
    """An error after which a job is not tried again."""


def final(error: Exception) -> bool:
    """Whether another attempt cannot help: gone or forbidden, or a model call that may not be repeated."""
    if isinstance(error, Unrecoverable):
        return True
    if isinstance(error, model_calls.CallError):
        return not error.retryable
    return getattr(error, "status", None) in FINAL_STATUSES


def tried(handle: Callable[[DataFrame, int], None], attempts: int = ingest.REVIEW_JOBS["attempts"], delay_ms: int = ingest.REVIEW_JOBS["delay_ms"], sleep: Callable[[float], None] = time.sleep) -> Callable[[DataFrame, int], None]:
    """A handler of batches that is run again after an error, with waits that double, unless the error is final."""

    def run(df: DataFrame, number: int) -> None:
        for attempt in range(1, attempts + 1):
            try:
                return handle(df, number)
            except Exception as e:  # noqa: BLE001  judged by final()
                if final(e) or attempt == attempts:
                    raise
                sleep(delay_ms * 2 ** (attempt - 1) / 1000)

    return run


class Done(NamedTuple):
    tables: dict[str, DataFrame]  #: all tables after the batch
    decided: DataFrame  #: (job_id, decision): superseded, closed, already_posted, or reviewed
    posts: DataFrame  #: what is to be delivered, keyed by review


def review_batch(jobs: DataFrame, pulls: DataFrame, files: DataFrame, tables: dict[str, DataFrame], config: Strategy, make_provider: Callable[[], model_calls.Provider], now, name: str, answers: DataFrame | None = None, parses: DataFrame | None = None) -> Done:
    """A batch of review jobs (streaming.ingest.review_jobs) from freshness to delivery.

    pulls: (repository_id, pull_number, current_sha, state, title, body, diff), as they are now; files: snapshots
    (repo_id, sha, path, blob_sha, size, content) by repository_id. Jobs whose head moved on or whose pull request is
    closed are skipped; reviews that were posted are not made again. Failed model calls mark their review.
    """
    fresh = checkpoint(ingest.current(jobs.dropDuplicates(["job_id"]), pulls))
    run = fresh.filter("decision = 'run'")
    contexts = run.select(F.col("installation_id").alias("github_installation_id"), F.col("owner").alias("account"), F.col("repository_id").alias("github_repo_id"), F.concat_ws("/", "owner", "repo").alias("full_name"), F.col("pull_number").alias("number"), "title", "head_sha", "base_sha", F.col("job_id").alias("seq"))
    after = dict(tables)
    after["installations"], after["repositories"] = (checkpoint(t) for t in store.upsert_repositories(tables["installations"], tables["repositories"], contexts))
    after["pull_requests"] = checkpoint(store.upsert_pull_requests(tables["pull_requests"], after["repositories"], contexts))
    repos = after["repositories"].select(F.col("id").alias("__repo"), F.col("github_repo_id").alias("repository_id"))
    known = run.join(repos, "repository_id").join(after["pull_requests"].select(F.col("repo_id").alias("__repo"), F.col("number").alias("pull_number"), F.col("id").alias("pr_id")), ["__repo", "pull_number"])
    wanted = known.select("pr_id", "head_sha", F.lit(config.hash).alias("config_hash"), F.lit(config.strategy).alias("strategy"), F.lit(stable_json(config.fields())).alias("strategy_config_json"), F.lit(config.model).alias("model"), F.lit(config.prompt_version).alias("prompt_version"), F.lit(now).cast("timestamp_ntz").alias("started_at"))
    claimed = store.claim_reviews(tables["reviews"], tables["candidate_comments"], wanted)
    claims = claimed.decided.select("pr_id", "head_sha", "review_id", F.col("decision").alias("claim"))
    open_ = checkpoint(known.join(claims, ["pr_id", "head_sha"]).select("job_id", F.col("repository_id").alias("repo_id"), F.col("head_sha").alias("sha"), "review_id", "title", "body", "diff", "claim"))
    reviews, candidates = checkpoint(claimed.reviews), checkpoint(claimed.candidates)
    changes = open_.filter("claim <> 'already_posted'").select("repo_id", "sha", "review_id", "title", "body", "diff")
    made = review.run_reviews(changes, files, config, make_provider, answers, parses)
    results = checkpoint(made.reviews)
    failed = results.filter("error_kind is not null").select("review_id", F.concat_ws(": ", "error_kind", "error").alias("error"), F.lit(now).cast("timestamp_ntz").alias("finished_at"))
    fine = results.filter("error_kind is null").select(
        "review_id", "served_model", "fallback_used", "prompt_hash", "schema_name", F.to_json(F.struct("strategy", "estimated_tokens", "diffs_included", "diffs_omitted", "files_included", "files_omitted")).alias("context_stats_json"), "redactions",
        *model_calls.USAGE, "cost_usd", "latency_ms", "attempts", "request_id", "called", F.lit(now).cast("timestamp_ntz").alias("finished_at"),
    )
    reviews, candidates = store.complete_reviews(reviews, candidates, fine, made.candidates)
    posts = checkpoint(review.posts(made, name))
    # the id of a delivery is made of the review's, so that delivering again replaces
    delivered = fine.select("review_id").join(posts.select("review_id", F.col("review_id").alias("github_review_id")), "review_id", "left")
    reviews, candidates = store.mark_posted(checkpoint(reviews), checkpoint(candidates), delivered)
    after["reviews"], after["candidate_comments"] = checkpoint(store.mark_failed(checkpoint(reviews), failed)), checkpoint(candidates)
    said = fresh.filter("decision <> 'run'").select("job_id", "decision").unionByName(open_.select("job_id", F.when(F.col("claim") == "already_posted", F.col("claim")).otherwise("reviewed").alias("decision")))
    return Done(after, said, posts)


def index_batch(jobs: DataFrame, files: DataFrame, tables: dict[str, DataFrame], parses: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """A batch of index jobs, the last of each repository: (tables after, statistics, parses to keep). files: snapshots by
    repository_id and sha."""
    last = jobs.dropDuplicates(["job_id"]).groupBy("repository_id").agg(F.max_by(F.struct("installation_id", "owner", "repo", "sha"), "delivery_id").alias("j")).select("repository_id", "j.*")
    contexts = last.select(F.col("installation_id").alias("github_installation_id"), F.col("owner").alias("account"), F.col("repository_id").alias("github_repo_id"), F.concat_ws("/", "owner", "repo").alias("full_name"), F.col("sha").alias("seq"))
    after = dict(tables)
    after["installations"], repositories = store.upsert_repositories(tables["installations"], tables["repositories"], contexts)
    repositories = checkpoint(repositories)
    repos = last.join(repositories.select("id", F.col("github_repo_id").alias("repository_id")), "repository_id").select(F.col("id").alias("own"), F.col("repository_id").alias("repo_id"), "sha")
    mine = files.join(repos, ["repo_id", "sha"]).withColumn("repo_id", F.col("own")).drop("own")
    run = review.index_files(mine, parses)
    g = link.kept(link.link(run.parses.select(*review.GRAPH, "path", "parse"), review.GRAPH))
    now = run.parses.select("repo_id", "path", "language", F.col("blob_sha").alias("blob_hash"))
    index = store.persist_index(tables["files"], tables["symbols"], tables["edges"], repos.select(F.col("own").alias("repo_id")), now, g.symbols, g.edges)
    after |= {"files": checkpoint(index.files), "symbols": checkpoint(index.symbols), "edges": checkpoint(index.edges)}
    done = repos.select(F.col("own").alias("id"), F.col("sha").alias("last_indexed_sha"))
    after["repositories"] = checkpoint(store.upsert(repositories, done, ["id"], ["last_indexed_sha"]))
    return after, index.stats.join(run.stats.select("repo_id", "files_listed", "files_indexed", "parsed", "from_cache", "unreadable"), "repo_id", "left"), run.new_parses
