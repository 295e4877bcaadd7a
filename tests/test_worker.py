from __future__ import annotations

import io
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from codeloom import logs, schemas
from codeloom.operators import model_calls, store
from codeloom.plans import worker
from codeloom.sources import settings, trees

from .samples import DIFF, HEAD, PATH, comment

NOW = datetime(2025, 3, 1)
JOB = "job_id string, delivery_id string, installation_id long, repository_id long, owner string, repo string, pull_number int, head_sha string, base_sha string"
PULL = "repository_id long, pull_number int, current_sha string, state string, title string, body string, diff string"


def tables(spark):
    return {n: store.empty(spark, n) for n in schemas.TABLES}


def snapshot(spark, sha="h"):
    return trees.memory(spark, {PATH: HEAD}).withColumn("repo_id", F.lit(9).cast("long")).withColumn("sha", F.lit(sha))


def provider(request=None):
    return model_calls.FakeProvider(lambda r, n: {"comments": [comment()]} if "boat.leaves" in r.prompt else model_calls.CallError("refusal", "declined"))


def test_from_jobs_to_posts(spark):
    jobs = spark.createDataFrame([(f"j{i}", str(i), 5, 9, "o", "r", i, "h", "b") for i in (1, 1, 2, 3, 4)], JOB)
    other = "diff --git a/x.ts b/x.ts\n--- a/x.ts\n+++ b/x.ts\n@@ -0,0 +1 @@\n+x\n"
    pulls = spark.createDataFrame([(9, 1, "h", "open", "t", None, DIFF), (9, 2, "newer", "open", "t", "", DIFF), (9, 3, "h", "closed", "t", "", DIFF), (9, 4, "h", "open", "t", "", other)], PULL)
    done = worker.review_batch(jobs, pulls, snapshot(spark), tables(spark), settings.PRESETS["S1"], provider, NOW, "Bot")
    assert {r["job_id"]: r["decision"] for r in done.decided.collect()} == {"j1": "reviewed", "j2": "superseded", "j3": "closed", "j4": "reviewed"}
    (post,) = done.posts.collect()
    assert post["body"].startswith("Bot left 1 comment.") and post["comments"][0]["line"] == 16
    rows = sorted((r["status"], r["error"], r["tokens_in"]) for r in done.tables["reviews"].collect())
    assert rows == [("failed", "refusal: declined", None), ("posted", None, 1000)]
    assert [(r["status"], r["posted"]) for r in done.tables["candidate_comments"].collect()] == [("selected", True)]
    assert schemas.violations(done.tables).count() == 0
    again = worker.review_batch(jobs, pulls, snapshot(spark), done.tables, settings.PRESETS["S1"], provider, NOW, "Bot")
    assert {r["job_id"]: r["decision"] for r in again.decided.collect()} == {"j1": "already_posted", "j2": "superseded", "j3": "closed", "j4": "reviewed"}
    assert again.posts.count() == 0 and again.tables["reviews"].count() == 2 and again.tables["candidate_comments"].count() == 1


def test_index_jobs(spark):
    jobs = spark.createDataFrame([("i1", "1", 5, 9, "o", "r", "old"), ("i2", "2", 5, 9, "o", "r", "h")], "job_id string, delivery_id string, installation_id long, repository_id long, owner string, repo string, sha string")
    after, stats, parses = worker.index_batch(jobs, snapshot(spark).unionByName(snapshot(spark, "old")), tables(spark))
    s = stats.first()
    assert (s["files_written"], s["symbols_written"], s["parsed"], s["from_cache"]) == (1, 6, 1, 0)
    assert after["repositories"].first()["last_indexed_sha"] == "h" and schemas.violations(after).count() == 0
    _, stats, _ = worker.index_batch(jobs, snapshot(spark), after, parses)
    s = stats.first()
    assert (s["files_kept"], s["files_written"], s["parsed"], s["from_cache"]) == (1, 0, 0, 1)


class Remote(Exception):
    def __init__(self, status):
        super().__init__(str(status))
        self.status = status


@pytest.mark.parametrize(("error", "times"), [(RuntimeError("x"), 3), (Remote(500), 3), (Remote(404), 1), (worker.Unrecoverable("x"), 1), (model_calls.CallError("auth", "x"), 1), (model_calls.CallError("server", "x"), 3)])
def test_attempts(error, times):
    calls, slept = [], []

    def handle(df, n):
        calls.append(n)
        raise error

    with pytest.raises(type(error)):
        worker.tried(handle, sleep=slept.append)(None, 4)
    assert len(calls) == times and slept == [5.0, 10.0][: times - 1]


def test_logs():
    out = io.StringIO()
    log = logs.create_logger("api", out)
    with logs.span("outer", log, pr=4):
        log.info("in", extra={"fields": {"headers": {"Authorization": "x", "X-Hub-Signature-256": "y", "a": 1}}})
        with pytest.raises(ValueError), logs.span("inner", log):
            raise ValueError("no")
    log.debug("not shown")
    lines = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [x["msg"] for x in lines] == ["in", "inner", "outer"] and lines[0]["headers"] == {"Authorization": "[redacted]", "X-Hub-Signature-256": "[redacted]", "a": 1}
    assert lines[1]["status"] == "error" and lines[1]["trace_id"] == lines[2]["trace_id"] != lines[1]["span_id"] and lines[2]["pr"] == 4
