"""Command line: review one change, or index one snapshot.

    spark-submit -m codeloom.cli review --diff FILE --repo DIR
    spark-submit -m codeloom.cli review --git DIR --base REV --head REV
    spark-submit -m codeloom.cli index --git DIR [--head REV] | --repo DIR
"""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import link, model_calls
from .operators.comments import status_counts
from .plans import review
from .sources import settings, trees


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="codeloom", description=__doc__.split("\n")[0])
    p.add_argument("command", choices=("review", "index"))
    for name, text in (
        ("diff", "a unified diff"), ("repo", "a working tree"), ("git", "a repository"), ("base", "the revision changed from"), ("head", "the revision changed to"), ("provider", "gemini or anthropic"), ("model", "instead of the provider's default"),
        ("body", "description of the change"), ("cache-dir", "answers to reuse and add to"), ("parse-cache", "parses to reuse and add to"), ("salt", "sets repeated runs apart"), ("out", "file for the result"),
    ):
        p.add_argument(f"--{name}", help=text)
    p.add_argument("--strategy", default="S1", choices=settings.STRATEGIES)
    p.add_argument("--title", default="Local review")
    p.add_argument("--budget", type=int, help="tokens of context")
    p.add_argument("--dry-run", action="store_true", help="print the prompt and call no model")
    a = p.parse_args(argv)
    if a.command == "index" and not (a.git or a.repo):
        p.error("index needs --git or --repo")
    if a.command == "review" and not (a.git and a.base and a.head or a.diff and a.repo):
        p.error("give either --diff and --repo, or --git with --base and --head")
    return a


def snapshot(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, str]:
    if a.git:
        spark.dataSource.register(trees.CommitSource)
        sha = trees.revision(a.git, a.head or "HEAD")
        files = spark.read.format("commit").option("revision", sha).load(a.git)
    else:
        sha, files = "working-tree", trees.working_tree(spark, a.repo)
    return files.withColumn("repo_id", F.lit(0)).withColumn("sha", F.lit(sha)), sha


def stored(spark: SparkSession, folder: str | None) -> DataFrame | None:
    try:
        return spark.read.parquet(folder) if folder else None
    except Exception as e:  # noqa: BLE001  the cache is new
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def main(argv: list[str] | None = None, senders: dict | None = None) -> int:
    a = arguments(argv)
    spark = SparkSession.builder.appName("codeloom").getOrCreate()
    files, sha = snapshot(spark, a)
    parses = stored(spark, a.parse_cache)
    if a.command == "index":
        index = review.index_files(files, parses)
        if a.parse_cache:
            index.new_parses.write.mode("append").parquet(a.parse_cache)
        g = link.kept(link.link(index.parses.select(*review.GRAPH, "path", "parse")))
        text = "\n".join(r["report"] for r in review.report(index, g).collect())
    else:
        config = settings.preset(a.strategy, a.provider, a.model)
        config = replace(config, context_token_budget=a.budget) if a.budget else config
        change = trees.diff_text(a.git, a.base, sha) if a.git else open(a.diff, encoding="utf-8").read()
        changes = spark.createDataFrame([(0, sha, 0, a.title, a.body, change)], "repo_id int, sha string, review_id int, title string, body string, diff string")
        make = model_calls.FakeProvider
        if not a.dry_run:
            import os

            make = lambda: model_calls.provider_from_env(dict(os.environ), senders or {}, a.provider)[0]
        run = review.run_reviews(changes, files, config, make, stored(spark, a.cache_dir), parses, a.salt)
        if a.cache_dir and not a.dry_run:
            run.cache_rows.write.mode("append").parquet(a.cache_dir)
        if a.parse_cache and run.index:
            run.index.new_parses.write.mode("append").parquet(a.parse_cache)
        sections = [r["text"] for r in run.sections.orderBy("at").collect()]
        if a.dry_run:
            print("\n\n".join(sections))
        print(summary(run), file=sys.stderr)
        text = json.dumps({"review": json.loads(review.as_json(run.reviews.collect()))[0], "candidates": json.loads(review.as_json(run.candidates.orderBy("index").collect()))}, indent=2)
        if a.dry_run and not a.out:
            return 0
    if a.out:
        with open(a.out, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        print(text)
    return 0


def summary(run: review.ReviewRun) -> str:
    r = run.reviews.first().asDict()
    counts = {x["status"]: x["n"] for x in status_counts(run.candidates, ["review_id"]).collect()}
    lines = [
        f"strategy {r['strategy']}, configuration {r['config_hash']}, prompt {r['prompt_version']}@{r['prompt_hash']}",
        f"context: about {r['estimated_tokens']} tokens; diffs {len(r['diffs_included'] or [])} in, {len(r['diffs_omitted'] or [])} out",
        f"model: {r['served_model']}, {r['input_tokens']} in, {r['output_tokens']} out, cost {r['cost_usd']}" if r["called"] else "model: not called (nothing reviewable)",
        f"candidates: {sum(counts.values())} {json.dumps(counts)}",
    ]
    lines += [f"  #{x['rank']} {x['file']}:{x['line']} [{x['severity']} {x['category']}] {x['claim']}" for x in run.selected.orderBy("seq").collect()]
    lines += [f"  rejected {x['file']}:{x['line']} ({x['reject_reason']}) {x['claim']}" for x in run.candidates.filter("status = 'invalid'").orderBy("index").collect()]
    return "\n".join(lines)


if __name__ == "__main__":
    sys.exit(main())
