"""Schemas of stored tables, with their keys. Parquet enforces neither keys nor references; ``violations`` looks for rows
that break them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLES = {
    "installations": "id long, github_installation_id long, account string, created_at timestamp_ntz",
    "repositories": "id long, installation_id long, github_repo_id long, full_name string, default_branch string, last_indexed_sha string, config_json string, created_at timestamp_ntz",
    "pull_requests": "id long, repo_id long, number int, title string, head_sha string, base_sha string, status string, updated_at timestamp_ntz",
    "reviews": (
        "id long, pr_id long, head_sha string, strategy string, config_hash string, strategy_config_json string, model string, served_model string, fallback_used boolean, prompt_version string, "
        "prompt_hash string, schema_name string, status string, error string, context_stats_json string, redactions map<string,long>, tokens_in long, tokens_out long, cache_read_tokens long, "
        "cache_write_tokens long, cost_usd decimal(12,6), latency_ms long, llm_attempts int, llm_request_id string, github_review_id long, started_at timestamp_ntz, finished_at timestamp_ntz"
    ),
    "candidate_comments": (
        "id long, review_id long, index int, file_path string, line int, category string, severity string, claim string, evidence string, suggested_fix string, body string, "
        "llm_confidence double, filter_score double, status string, reject_reason string, duplicate_of_index int, rank int, posted boolean"
    ),
    "parsed_blobs": "key string, parse string, created_at timestamp_ntz",
    "files": "id long, repo_id long, path string, language string, blob_hash string, parser_version int",
    "symbols": "id long, file_id long, local_index int, name string, qualified_name string, kind string, start_line int, end_line int, signature string, exported boolean, parent_symbol_id long",
    "edges": "id long, repo_id long, src_symbol_id long, dst_symbol_id long, kind string",
}
KEYS = {
    "installations": ["github_installation_id"],
    "repositories": ["github_repo_id"],
    "pull_requests": ["repo_id", "number"],
    "reviews": ["pr_id", "head_sha", "config_hash"],
    "candidate_comments": ["review_id", "index"],
    "parsed_blobs": ["key"],
    "files": ["repo_id", "path"],
    "symbols": ["file_id", "local_index"],
}
REFERENCES = [
    ("repositories", "installation_id", "installations"),
    ("pull_requests", "repo_id", "repositories"),
    ("reviews", "pr_id", "pull_requests"),
    ("candidate_comments", "review_id", "reviews"),
    ("files", "repo_id", "repositories"),
    ("symbols", "file_id", "files"),
    ("symbols", "parent_symbol_id", "symbols"),
    ("edges", "repo_id", "repositories"),
    ("edges", "src_symbol_id", "symbols"),
    ("edges", "dst_symbol_id", "symbols"),
]
# What enumerations hold.
STATUSES = {"reviews": ("running", "completed", "posted", "failed"), "candidate_comments": ("selected", "over_cap", "duplicate", "invalid")}


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(rule, n) for every rule that some rows break: unique keys, references, enumerations."""
    out = None
    spark = next(iter(tables.values())).sparkSession
    found = []
    for name, key in KEYS.items():
        if name in tables:
            found.append((f"unique {name}({', '.join(key)})", tables[name].groupBy(*key).count().filter("count > 1")))
    for name, column, target in REFERENCES:
        if name in tables and target in tables:
            rows = tables[name].filter(F.col(column).isNotNull())
            found.append((f"{name}.{column} refers to {target}", rows.join(tables[target].select(F.col("id").alias(column)), column, "left_anti")))
    for name, values in STATUSES.items():
        if name in tables:
            found.append((f"{name}.status", tables[name].filter(~F.col("status").isin(*values))))
    for rule, rows in found:
        counted = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "n")
        out = counted if out is None else out.unionByName(counted)
    return (out if out is not None else spark.createDataFrame([], "rule string, n long")).filter("n > 0")
