from __future__ import annotations

import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from codeloom import cli
from codeloom.functions import timing
from codeloom.sources import trees
from codeloom.streaming import ingest

from .samples import BEFORE, DIFF, HEAD, PATH


def write(folder, files):
    for path, content in files.items():
        full = os.path.join(folder, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w", encoding="utf-8") as f:
            f.write(content)


def test_working_tree(spark, tmp_path):
    root = str(tmp_path / "a b")
    write(root, {"src/x.ts": "hello\n", "README.md": "hello\n", "node_modules/v/i.js": "x", ".git/config": "x", "big.ts": "x" * 600_000, "huge.md": "x" * 1_000_001})
    got = {r["path"]: r for r in trees.working_tree(spark, root).collect()}
    assert set(got) == {"src/x.ts", "README.md", "big.ts", "huge.md"}
    assert got["src/x.ts"]["blob_sha"] == "ce013625030ba8dba906f756967f9e9ca394464a" and got["README.md"]["blob_sha"] == "unhashed:README.md" and got["big.ts"]["blob_sha"] == "unhashed:big.ts"
    assert got["huge.md"]["content"] is None and got["README.md"]["content"] == "hello\n"


def test_paths_that_leave_the_root(spark):
    paths = {"a/b": True, "a/../b": True, "../b": False, "a/../../b": False, "/etc": False, "a/./..": True, "..": False}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r["p"]: r["k"] for r in df.select("p", trees.inside(F.col("p")).alias("k")).collect()} == paths


def test_listings(spark):
    text = "100644 blob aaa      12\tsrc/a b.ts\x00120000 blob bbb 3\tlink\x00160000 commit ccc -\tsub\x00100755 blob ddd 5\ttab\tname\x00"
    df = spark.createDataFrame([(1, "h", text)], "repo_id int, sha string, listing string")
    assert sorted((r["path"], r["blob_sha"], r["size"]) for r in trees.tree_records(df).collect()) == [("src/a b.ts", "aaa", 12), ("tab\tname", "ddd", 5)]
    api = spark.createDataFrame([("blob", "100644", "a", "s", 1, True), ("blob", "120000", "l", "s", 1, True), ("tree", "040000", "t", "s", None, True), ("blob", "100644", None, "s", 1, True)], "type string, mode string, path string, sha string, size int, truncated boolean")
    assert [tuple(r) for r in trees.tree_entries(api).collect()] == [("a", "s", 1, True)]


def test_reads(spark):
    files = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (1, "b", "y" * 1_000_001)], "k int, path string, content string")
    wanted = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (1, "c")], "k int, path string")
    assert sorted((r["path"], r["content"]) for r in trees.read_once(wanted, files, ["k"]).collect() if r["content"]) == [("a", "x")]
    assert trees.read_once(wanted, files, ["k"]).count() == 3


@pytest.fixture
def repository(tmp_path):
    folder = str(tmp_path / "r")
    os.makedirs(folder)
    git = lambda *a: subprocess.run(["git", "-C", folder, "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    write(folder, {PATH: BEFORE, "README.md": "x", "é.ts": "export const q = 1;\n"})
    os.symlink("README.md", os.path.join(folder, "link.ts"))
    git("add", "-A")
    git("commit", "-qm", "one")
    write(folder, {PATH: HEAD})
    git("commit", "-qam", "two")
    return folder


def test_commits(spark, repository):
    spark.dataSource.register(trees.CommitSource)
    got = {r["path"]: r for r in spark.read.format("commit").option("revision", "HEAD~1").option("filesPerTask", 1).load(repository).collect()}
    assert set(got) == {PATH, "README.md", "é.ts"}
    assert got[PATH]["content"] == BEFORE and got["README.md"]["content"] is None and got["README.md"]["size"] == 1
    objects = trees.Objects(repository)
    assert objects.read(f"HEAD:{PATH}") == HEAD and objects.read("HEAD:none") is None and objects.read("HEAD:app") is None and objects.read("a\nb") is None and objects.read("HEAD:é.ts") == "export const q = 1;\n"
    objects.close()
    assert "+    if (s.seats < seats) continue;" in trees.diff_text(repository, "HEAD~1", "HEAD")
    with pytest.raises(subprocess.CalledProcessError):
        trees.revision(repository, "none")


def test_command_line(spark, repository, tmp_path, capsys):
    out, cache = str(tmp_path / "out.json"), str(tmp_path / "parses")
    assert cli.main(["index", "--git", repository, "--out", out, "--parse-cache", cache]) == 0
    said = json.load(open(out))
    assert said["files_indexed"] == 2 and said["parsed"] == 2 and said["symbol_kinds"]["function"] == 3
    assert cli.main(["index", "--git", repository, "--out", out, "--parse-cache", cache]) == 0
    assert json.load(open(out))["from_cache"] == 2
    assert cli.main(["review", "--git", repository, "--base", "HEAD~1", "--head", "HEAD", "--dry-run", "--strategy", "S4"]) == 0
    shown = capsys.readouterr()
    assert f'<diff path="{PATH}" status="modified">' in shown.out and "strategy S4" in shown.err
    with open(tmp_path / "c.diff", "w") as f:
        f.write(DIFF)
    os.makedirs(tmp_path / "w" / "app")
    with open(tmp_path / "w" / PATH, "w") as f:
        f.write(HEAD)
    assert cli.main(["review", "--diff", str(tmp_path / "c.diff"), "--repo", str(tmp_path / "w"), "--dry-run", "--out", out, "--budget", "500"]) == 0
    assert json.load(open(out))["review"]["diffs_included"] == [PATH]
    with pytest.raises(SystemExit):
        cli.arguments(["review", "--diff", "x"])


# ---- events

SHA = "a" * 40


def payload(kind, **changes):
    base = {"installation": {"id": 5}, "repository": {"id": 3_000_000_000, "name": "r", "default_branch": "main", "owner": {"login": "o"}}}
    if kind == "pull_request":
        base |= {"action": "opened", "pull_request": {"number": 7, "head": {"sha": SHA}, "base": {"sha": "b" * 40}}}
    elif kind == "push":
        base |= {"ref": "refs/heads/main", "after": SHA, "deleted": False}
    return json.dumps(base | changes)


EVENTS = [
    ("ping", "{}", None, "pong", 200), ("pull_request", payload("pull_request"), None, "queued", 202), ("pull_request", payload("pull_request", action="synchronize"), None, "queued", 202),
    ("pull_request", payload("pull_request", action="closed"), None, "ignored", 200), ("pull_request", payload("pull_request", pull_request={"number": "x"}), None, "malformed pull_request payload", 400),
    ("pull_request", "{}", None, "malformed pull_request payload", 400), ("push", payload("push"), None, "queued", 202), ("push", payload("push", ref="refs/heads/x"), None, "ignored", 200),
    ("push", payload("push", deleted=True), None, "ignored", 200), ("push", payload("push", after="0" * 40), None, "ignored", 200), ("push", payload("push", installation=None), None, "malformed push payload", 400),
    ("issues", payload("push"), None, "ignored", 200), ("push", "{not json", None, "invalid JSON", 400), ("ping", "{}", "sha256=" + "0" * 64, "invalid signature", 401), ("pull_request", payload("pull_request"), "", "invalid signature", 401),
]
RAW = "delivery_id string, ts timestamp, event string, signature string, raw_body binary"


def raw_events(spark):
    from datetime import datetime, timedelta

    rows = [(str(i), datetime(2025, 1, 1) + timedelta(minutes=i), e, s if s is not None else timing.sign("k", b.encode()), b.encode()) for i, (e, b, s, _, _) in enumerate(EVENTS)]
    return spark.createDataFrame(rows, RAW)


def test_routing(spark):
    got = {r["delivery_id"]: r for r in ingest.routed(raw_events(spark), "k").collect()}
    for i, (event, _, _, outcome, status) in enumerate(EVENTS):
        assert (got[str(i)]["outcome"], got[str(i)]["status"]) == (outcome, status), (i, event)
    jobs = ingest.once(ingest.review_jobs(ingest.routed(raw_events(spark), "k"))).collect()
    assert [j["job_id"] for j in jobs] == [f"pr-3000000000-7-{SHA}"] and jobs[0]["owner"] == "o"
    assert [j["job_id"] for j in ingest.index_jobs(ingest.routed(raw_events(spark), "k")).collect()] == [f"index-3000000000-{SHA}"]


def test_superseded_and_closed(spark):
    jobs = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (3, 1, "d")], "repository_id long, pull_number int, head_sha string")
    heads = spark.createDataFrame([(1, 1, "a", "open"), (1, 2, "x", "open"), (2, 1, "c", "closed")], "repository_id long, pull_number int, current_sha string, state string")
    assert sorted((r["head_sha"], r["decision"]) for r in ingest.current(jobs, heads).collect()) == [("a", "run"), ("b", "superseded"), ("c", "closed"), ("d", "superseded")]


def test_stream_hands_each_job_on_once(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    handled = []

    def go():
        stream = spark.readStream.schema(RAW).parquet(source)
        q = ingest.start(ingest.once(ingest.review_jobs(ingest.routed(stream, "k"))), folder, str(tmp_path / "state"), lambda df, n: handled.extend(r["job_id"] for r in df.collect()))
        q.awaitTermination()

    raw_events(spark).write.mode("append").parquet(source)
    go()
    assert handled == [f"pr-3000000000-7-{SHA}"]
    raw_events(spark).write.mode("append").parquet(source)  # delivered again
    go()
    assert len(handled) == 1
    other = payload("pull_request", pull_request={"number": 8, "head": {"sha": "c" * 40}, "base": {"sha": "b" * 40}})
    raw_events(spark).limit(1).select("delivery_id", "ts", F.lit("pull_request").alias("event"), F.lit(timing.sign("k", other.encode())).alias("signature"), F.encode(F.lit(other), "UTF-8").alias("raw_body")).write.mode("append").parquet(source)
    go()
    assert handled[1:] == [f"pr-3000000000-8-{'c' * 40}"]
    assert spark.read.parquet(f"{folder}/jobs").count() == 2
