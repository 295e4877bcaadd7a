from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from codeloom import schemas
from codeloom.operators import comments, link, store
from codeloom.plans import review
from codeloom.sources import trees

T0, T1 = datetime(2025, 1, 1), datetime(2025, 1, 2)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


def test_upserts(spark):
    ctx = spark.createDataFrame([(5, "org", 3_000_000_000, "org/a", 1), (5, "renamed", 3_000_000_000, "org/b", 2), (6, "two", 9, "two/x", 3)], "github_installation_id long, account string, github_repo_id long, full_name string, seq int")
    inst, repos = store.upsert_repositories(store.empty(spark, "installations"), store.empty(spark, "repositories"), ctx)
    assert rows(inst, "github_installation_id", "account") == [(5, "org"), (6, "two")]
    assert rows(repos, "github_repo_id", "full_name") == [(9, "two/x"), (3_000_000_000, "org/b")]
    before = rows(repos, "github_repo_id", "id")
    moved = spark.createDataFrame([(6, "two", 3_000_000_000, "two/b", 9)], ctx.schema)
    inst2, repos2 = store.upsert_repositories(inst, repos, moved)
    assert rows(repos2, "github_repo_id", "id") == before and rows(repos2, "full_name") == [("two/b",), ("two/x",)] and inst2.count() == 2
    prs = spark.createDataFrame([(9, 4, "t", "h1", "b", 1), (9, 4, "t2", "h2", "b", 2), (9, 5, "u", "h", "b", 1)], "github_repo_id long, number int, title string, head_sha string, base_sha string, seq int")
    table = store.upsert_pull_requests(store.empty(spark, "pull_requests"), repos, prs)
    assert rows(table, "number", "title", "head_sha", "status") == [(4, "t2", "h2", "open"), (5, "u", "h", "open")]
    assert schemas.violations({"installations": inst2, "repositories": repos2, "pull_requests": table}).count() == 0


WANTED = "pr_id long, head_sha string, config_hash string, strategy string, strategy_config_json string, model string, prompt_version string, started_at timestamp_ntz"


def claim(spark, reviews, candidates, *keys, at=T0):
    return store.claim_reviews(reviews, candidates, spark.createDataFrame([(*k, "S1", "{}", "m", "review/v1", at) for k in keys], WANTED))


def test_life_of_a_review(spark):
    first = claim(spark, store.empty(spark, "reviews"), store.empty(spark, "candidate_comments"), (1, "h", "c"), (1, "h", "c"), (2, "h", "c"))
    assert rows(first.decided, "pr_id", "decision") == [(1, "new"), (2, "new")] and rows(first.reviews, "status") == [("running",)] * 2
    ids = dict(rows(first.decided, "pr_id", "review_id"))
    run = spark.createDataFrame(
        [(ids[1], "served", False, "ph", comments.SCHEMA_NAME, "{}", {"jwt": 2}, 1000, 200, 0, 0, 0.0108, 4210.7, 1, "rq", True, T1), (ids[2], None, None, "ph", comments.SCHEMA_NAME, "{}", None, None, None, None, None, None, None, None, None, False, T1)],
        "review_id long, served_model string, fallback_used boolean, prompt_hash string, schema_name string, context_stats_json string, redactions map<string,long>, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, cost_usd double, latency_ms double, attempts int, request_id string, called boolean, finished_at timestamp_ntz",
    )
    found = spark.createDataFrame(
        [(ids[1], 0, "f", 1, "bug", "low", "c", "e", None, 0.5, "b", "selected", None, None, 1), (ids[1], 1, "f", 2, "bug", "low", "c", "e", "x", 0.5, "b", "invalid", "empty_claim", None, None)],
        "review_id long, index int, file string, line int, category string, severity string, claim string, evidence string, suggested_fix string, confidence double, body string, status string, reject_reason string, duplicate_of int, rank int",
    )
    reviews, candidates = store.complete_reviews(first.reviews, first.candidates, run, found)
    got = {r["pr_id"]: r for r in reviews.collect()}
    assert (got[1]["status"], got[1]["latency_ms"], str(got[1]["cost_usd"]), got[1]["redactions"]) == ("completed", 4211, "0.010800", {"jwt": 2})
    assert (got[2]["tokens_in"], str(got[2]["cost_usd"]), got[2]["latency_ms"], got[2]["llm_attempts"]) == (0, "0.000000", 0, 0)
    posted = spark.createDataFrame([(ids[1], 77), (ids[2], None)], "review_id long, github_review_id long")
    reviews, candidates = store.mark_posted(reviews, candidates, posted)
    assert rows(candidates, "index", "posted") == [(0, True), (1, False)] and rows(reviews, "status") == [("posted",)] * 2
    again = claim(spark, reviews, candidates, (1, "h", "c"), (1, "h2", "c"), at=T1)
    assert rows(again.decided, "head_sha", "decision", "github_review_id") == [("h", "already_posted", 77), ("h2", "new", None)]
    assert again.candidates.count() == 2 and again.reviews.count() == 3
    failed = store.mark_failed(again.reviews, spark.createDataFrame([(dict(rows(again.decided, "head_sha", "review_id"))["h2"], "Error: " + "x" * 5000, T1)], "review_id long, error string, finished_at timestamp_ntz"))
    assert max(len(r["error"] or "") for r in failed.collect()) == 4000
    reset = claim(spark, failed, candidates, (1, "h2", "c"), at=T1)
    assert rows(reset.decided, "decision") == [("reset",)] and rows(reset.reviews.filter("head_sha = 'h2'"), "status", "error", "finished_at") == [("running", None, None)]
    assert schemas.violations({"reviews": reset.reviews, "candidate_comments": candidates}).count() == 0


A = {"a.ts": "import { b } from './b';\nexport class A { m() { b(); } }\n", "b.ts": "export function b() {}\n", "c.ts": "export const c = 1;\n", "README.md": "x"}


def indexed(spark, contents, tables):
    files = trees.memory(spark, contents).withColumn("repo_id", F.lit(1).cast("long")).withColumn("sha", F.lit("h"))
    run = review.index_files(files)
    g = link.link(link.checkpoint(run.parses.select(*review.GRAPH, "path", "parse")), review.GRAPH)
    now = run.parses.select("repo_id", "path", "language", F.col("blob_sha").alias("blob_hash"))
    return store.persist_index(*tables, spark.createDataFrame([(1,)], "repo_id long"), now, g.symbols, g.edges)


def test_incremental_index(spark):
    empty = [store.empty(spark, n) for n in ("files", "symbols", "edges")]
    other = spark.createDataFrame([(99, 2, "z.ts", "typescript", "q", 2)], schemas.TABLES["files"])
    first = indexed(spark, A, [empty[0].unionByName(other), *empty[1:]])
    assert first.stats.first().asDict() == {"repo_id": 1, "files_kept": 0, "files_written": 3, "files_deleted": 0, "symbols_written": 7, "edges": 2}
    parents = {r["qualified_name"]: r for r in first.symbols.collect()}
    assert parents["A.m"]["parent_symbol_id"] == parents["A"]["id"]
    tables = [link.checkpoint(t) for t in first[:3]]
    changed = {"a.ts": A["a.ts"].replace("b()", "b(1)"), "b.ts": A["b.ts"]}
    second = indexed(spark, changed, tables)
    assert second.stats.first().asDict() == {"repo_id": 1, "files_kept": 1, "files_written": 1, "files_deleted": 2, "symbols_written": 3, "edges": 2}
    assert rows(second.files, "path") == [("a.ts",), ("b.ts",), ("z.ts",)]
    old, new = (dict(rows(t, "path", "id")) for t in (tables[0], second.files))
    assert old["b.ts"] == new["b.ts"] and old["a.ts"] != new["a.ts"]
    repos = spark.createDataFrame([(1,), (2,)], "id long")
    assert schemas.violations({"files": second.files, "symbols": second.symbols, "edges": second.edges, "repositories": repos.selectExpr("id", "id as github_repo_id", "cast(null as long) as installation_id")}).count() == 0


def test_violations_are_found(spark):
    files = spark.createDataFrame([(1, 5, "a", "t", "b", 2), (2, 5, "a", "t", "b", 2)], schemas.TABLES["files"])
    edges = spark.createDataFrame([(1, 5, 7, 8, "calls")], schemas.TABLES["edges"])
    reviews = store.empty(spark, "reviews").unionByName(spark.createDataFrame([(1, "odd")], "id long, status string"), allowMissingColumns=True)
    got = {r["rule"]: r["n"] for r in schemas.violations({"files": files, "edges": edges, "symbols": store.empty(spark, "symbols"), "reviews": reviews}).collect()}
    assert got == {"unique files(repo_id, path)": 1, "edges.src_symbol_id refers to symbols": 1, "edges.dst_symbol_id refers to symbols": 1, "reviews.status": 1}


def test_caches_append_new_keys(spark):
    table = spark.createDataFrame([("a", 1)], "key string, v int")
    assert rows(store.append_new(table, spark.createDataFrame([("a", 2), ("b", 3), ("b", 3)], table.schema), ["key"]), "key", "v") == [("b", 3)]
