"""Webhook events as a stream: verified, routed, turned into jobs with ids of their own, and handed on exactly once per id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import index_job_id, review_job_id
from ..functions.timing import verified

# What is reviewed, how large a body may be, and how often a job is tried.
REVIEW_ACTIONS = ("opened", "synchronize")
MAX_BODY = 25 * 1024 * 1024
REVIEW_JOBS = {"queue": "review", "attempts": 3, "delay_ms": 5_000, "concurrency": 4, "lock_ms": 120_000}
INDEX_JOBS = {"queue": "index", "attempts": 3, "delay_ms": 30_000, "concurrency": 1, "lock_ms": 300_000}
SHA = "^[0-9a-f]{40}$"
REPOSITORY = "id:long,name:string,default_branch:string,owner:struct<login:string>"
PAYLOAD = (
    f"struct<action:string,ref:string,after:string,deleted:boolean,installation:struct<id:long>,repository:struct<{REPOSITORY}>,"
    "pull_request:struct<number:int,head:struct<sha:string>,base:struct<sha:string>>,_corrupt_record:string>"
)


def routed(events: DataFrame, secret: str) -> DataFrame:
    """Adds status and outcome to raw events (delivery_id, event, signature, raw_body), and the fields of jobs.

    Signatures are checked on the bytes as they came, before JSON is read: 401. Bodies that are too large or aren't JSON,
    and those of known events without a required field: 413 or 400. Pings: 200 pong. Pushes to the default branch that
    leave a commit, and opened or updated pull requests: 202 queued. All else: 200 ignored.
    """
    ok = verified(secret, F.col("raw_body"), F.col("signature"))
    out = events.withColumn("__ok", ok)
    text = F.when(F.col("__ok") & (F.octet_length("raw_body") <= MAX_BODY), F.decode("raw_body", "UTF-8"))
    out = out.withColumn("__json", F.try_parse_json(text))
    out = out.withColumn("p", F.from_json(text, PAYLOAD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    p = lambda name: F.col(f"p.{name}")
    base = p("installation.id").isNotNull() & p("repository.id").isNotNull() & p("repository.name").isNotNull() & p("repository.owner.login").isNotNull()
    base = base & p("_corrupt_record").isNull()
    push_ok = base & p("ref").isNotNull() & p("after").isNotNull() & p("deleted").isNotNull() & p("repository.default_branch").isNotNull()
    pull_ok = base & p("action").isNotNull() & p("pull_request.number").isNotNull() & p("pull_request.head.sha").rlike(SHA) & p("pull_request.base.sha").rlike(SHA)
    pull_ok, push_ok = F.coalesce(pull_ok, F.lit(False)), F.coalesce(push_ok, F.lit(False))
    event = F.col("event")
    to_default = ~p("deleted") & (p("ref") == F.concat(F.lit("refs/heads/"), p("repository.default_branch"))) & ~p("after").rlike("^0+$")
    outcome = (
        F.when(~F.col("__ok"), "invalid signature")
        .when(F.octet_length("raw_body") > MAX_BODY, "too large")
        .when(F.col("__json").isNull(), "invalid JSON")
        .when(event == "ping", "pong")
        .when((event == "push") & ~push_ok, "malformed push payload")
        .when((event == "push") & to_default, "queued")
        .when((event == "pull_request") & ~pull_ok, "malformed pull_request payload")
        .when((event == "pull_request") & p("action").isin(*REVIEW_ACTIONS), "queued")
        .otherwise("ignored")
    )
    codes = {"invalid signature": 401, "too large": 413, "invalid JSON": 400, "malformed push payload": 400, "malformed pull_request payload": 400, "queued": 202}
    status = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in codes.items() for x in pair]), F.col("outcome")), F.lit(200))
    out = out.withColumn("outcome", outcome).withColumn("status", status)
    keep = [c for c in events.columns if c not in ("raw_body", "signature")]
    return out.select(
        *keep, "outcome", "status", p("installation.id").alias("installation_id"), p("repository.id").alias("repository_id"), p("repository.owner.login").alias("owner"), p("repository.name").alias("repo"),
        p("pull_request.number").alias("pull_number"), p("pull_request.head.sha").alias("head_sha"), p("pull_request.base.sha").alias("base_sha"), p("after").alias("sha"),
    )


def review_jobs(events: DataFrame) -> DataFrame:
    """Jobs from routed events, one id per (repository, pull request, commit)."""
    queued = events.filter("outcome = 'queued' and event = 'pull_request'")
    return queued.withColumn("job_id", review_job_id(F.col("repository_id"), F.col("pull_number"), F.col("head_sha"))).drop("outcome", "status", "event", "sha")


def index_jobs(events: DataFrame) -> DataFrame:
    """Jobs from routed events, one id per (repository, commit)."""
    queued = events.filter("outcome = 'queued' and event = 'push'").filter(F.col("sha").rlike(SHA))
    return queued.withColumn("job_id", index_job_id(F.col("repository_id"), F.col("sha"))).select(*[c for c in queued.columns if c not in ("outcome", "status", "event", "pull_number", "head_sha", "base_sha")], "job_id")


def once(jobs: DataFrame, time_col: str = "ts", within: str = "1 day") -> DataFrame:
    """Each job id once. On a stream ids are remembered for a span of event time, which bounds the state; the durable check
    is ``unclaimed``."""
    if jobs.isStreaming:
        return jobs.withWatermark(time_col, within).dropDuplicatesWithinWatermark(["job_id"])
    return jobs.dropDuplicates(["job_id"])


def unclaimed(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """Jobs whose id is not among those done."""
    return jobs.join(done.select("job_id"), "job_id", "left_anti")


def current(jobs: DataFrame, heads: DataFrame) -> DataFrame:
    """Adds decision: ``superseded`` where the pull request's head has moved on, ``closed`` where it isn't open, else ``run``.
    heads: (repository_id, pull_number, current_sha, state)."""
    joined = jobs.join(heads, ["repository_id", "pull_number"], "left")
    decision = F.when(F.coalesce(F.col("current_sha"), F.lit("")) != F.col("head_sha"), "superseded").when(F.col("state") != "open", "closed").otherwise("run")
    return joined.withColumn("decision", decision)


def latest_heads(events: DataFrame, order: list[str]) -> DataFrame:
    """(repository_id, pull_number, current_sha): the head of the last event of each pull request."""
    return events.groupBy("repository_id", "pull_number").agg(F.max_by("head_sha", F.struct(*order)).alias("current_sha"))


def start(jobs: DataFrame, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None], trigger: dict | None = None):
    """Runs jobs in micro-batches. A batch is restarted after a failure until it succeeds, and then not seen again; ids
    that an earlier run of the same batch wrote to ``folder`` are dropped, so handling is idempotent by job id."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        fresh = df.dropDuplicates(["job_id"])
        path = f"{folder}/jobs"
        try:
            done = spark.read.parquet(path)
        except Exception as e:  # noqa: BLE001  nothing has been written yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            done = None
        if done is not None:
            fresh = unclaimed(fresh, done.filter(F.col("batch") != number))
        fresh = fresh.persist()
        handle(fresh, number)
        fresh.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
        fresh.unpersist()

    return jobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
