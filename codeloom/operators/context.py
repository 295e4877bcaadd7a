"""What a review gets to see: reviewable files, whole pieces within a token budget, symbols around a change."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import escape_attribute, estimate_tokens, file_lines, numbered, padded, render_diff, render_file, trim
from .extract import language_of

# What is never indexed, what is never shown, and limits.
VENDORED = r"(^|/)(node_modules|dist|build|out|coverage|vendor|\.git|\.next|\.turbo)/"
MINIFIED = r"\.min\.[cm]?js$"
IGNORED = (
    r"(^|/)(package-lock\.json|pnpm-lock\.yaml|yarn\.lock|npm-shrinkwrap\.json|bun\.lockb?)$",
    r"(^|/)(dist|build|out|coverage|node_modules|vendor)/",
    r"\.min\.(js|css)$",
    r"\.map$",
    r"\.snap$",
)
MAX_INDEXED = 512_000
EXCERPT_LINES = 15


def is_indexable(path: Column, size: Column | None = None) -> Column:
    """Whether a file is source code to parse: a known language, not vendored, minified or too large."""
    out = language_of(path).isNotNull() & ~path.rlike(VENDORED) & ~path.rlike(MINIFIED)
    return out if size is None else out & F.coalesce(size <= MAX_INDEXED, F.lit(True))


def is_ignored(path: Column) -> Column:
    out = F.lit(False)
    for pattern in IGNORED:
        out = out | path.rlike(pattern)
    return out


def is_reviewable(files: DataFrame) -> DataFrame:
    """Files of a diff to review: text, not deleted, not ignored, with hunks."""
    return files.filter(~F.col("binary") & F.col("new_path").isNotNull() & (F.size("hunks") > 0)).filter(~is_ignored(F.col("new_path")))


def budget_taken(pieces: Column, budget: Column) -> Column:
    """Which of the pieces, an array of structs with ``tokens`` in the order of offering, fit: each whole or not at all, and
    one that doesn't fit doesn't stop later ones. An array of booleans beside it, in one fold."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("taken"))

    def offer(state: Column, piece: Column) -> Column:
        fits = piece["tokens"].cast("long") <= budget.cast("long") - state["used"]
        used = F.when(fits, state["used"] + piece["tokens"]).otherwise(state["used"]).cast("long")
        return F.struct(used.alias("used"), F.concat(state["taken"], F.array(F.coalesce(fits, F.lit(False)))).alias("taken"))

    return F.aggregate(pieces, start, offer, lambda s: s["taken"])


def take_within(pieces: DataFrame, keys: list[str], order: str, budget: Column) -> DataFrame:
    """Adds ``taken`` to (keys, order, tokens). Only order and tokens are gathered, never the texts."""
    listed = pieces.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "tokens"))).alias("p"), F.max(budget).alias("b"))
    flags = listed.select(*keys, F.inline(F.arrays_zip(F.col("p")[order].alias(order), budget_taken(F.col("p"), F.col("b")).alias("taken"))))
    return pieces.join(flags, [*keys, order])


def base_context(files: DataFrame, heads: DataFrame, reviews: DataFrame, keys: list[str]) -> DataFrame:
    """The pieces offered for each review, with ``taken``: (keys, seq, kind, path, text, tokens, taken).

    All diffs come first in the order of the diff. Strategy S1 then offers the whole files of the diffs that were taken;
    where a head is missing the text is null and the piece is not taken. reviews has (keys, strategy, budget); heads
    (keys, path, content), scrubbed like the diffs.
    """
    chosen = reviews.select(*keys, "strategy", "budget")
    diffs = files.join(chosen, keys).select(*keys, F.col("file_seq").alias("seq"), F.lit("diff").alias("kind"), F.col("new_path").alias("path"), render_diff(F.col("new_path"), F.col("status"), F.col("hunks")).alias("text"), "strategy", "budget")
    diffs = diffs.withColumn("tokens", estimate_tokens(F.col("text")))
    diffs = take_within(diffs, keys, "seq", F.col("budget"))
    spent = diffs.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("taken"), F.col("tokens"))), F.lit(0)).alias("spent"))
    whole = diffs.filter("taken and strategy = 'S1'").drop("text", "tokens", "taken", "kind").join(heads, [*keys, "path"], "left").join(spent, keys)
    whole = whole.withColumn("text", render_file(F.col("path"), F.col("content"))).withColumn("tokens", estimate_tokens(F.col("text")))
    taken = take_within(whole.filter("text is not null"), keys, "seq", F.col("budget") - F.col("spent"))
    missing = whole.filter("text is null").withColumn("taken", F.lit(False))
    columns = [*keys, "kind", "path", "text", "tokens", "taken", "seq"]
    extra = taken.unionByName(missing).withColumn("kind", F.lit("file")).select(*columns)
    pieces = diffs.select(*columns).unionByName(extra)
    order = W.partitionBy(*keys).orderBy(F.when(F.col("kind") == "diff", 0).otherwise(1), "seq")
    return pieces.withColumn("seq", F.row_number().over(order) - 1).select(*keys, "seq", "kind", "path", "text", "tokens", "taken")


def context_stats(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, estimated_tokens, diffs_included, diffs_omitted, files_included, files_omitted), paths in order."""
    ordered = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("seq", "path")))), lambda x: x["path"])
    is_diff, taken = F.col("kind") == "diff", F.col("taken")
    return pieces.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(taken, F.col("tokens"))), F.lit(0)).cast("long").alias("estimated_tokens"),
        ordered(is_diff & taken).alias("diffs_included"),
        ordered(is_diff & ~taken).alias("diffs_omitted"),
        ordered(~is_diff & taken).alias("files_included"),
        ordered(~is_diff & ~taken).alias("files_omitted"),
    )


def symbol_views(candidates: DataFrame, heads: DataFrame, keys: list[str]) -> DataFrame:
    """Adds to ranked candidates their three renderings with estimates: whole, excerpt around changed lines, signature.

    All are column expressions over the file's lines; null where the head is missing, or without changed lines.
    """
    rows = candidates.join(heads.select(*keys, "path", file_lines(F.col("content")).alias("lines")), [*keys, "path"], "left")
    width = F.char_length(F.col("end_line").cast("string"))
    lines_attr = F.concat(F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))

    def shown(body: Column, note: str) -> Column:
        head = F.concat(F.lit('<symbol path="'), escape_attribute(F.col("path")), F.lit('" name="'), escape_attribute(F.col("qualified_name")), F.lit('" kind="'), F.col("kind"), F.lit('" lines="'), lines_attr, F.lit('" relation="'), F.col("relation"), F.lit(f'"{note}>\n'))
        return F.concat(head, body, F.lit("\n</symbol>"))

    def part(low: Column, high: Column) -> Column:
        return numbered(F.slice("lines", low, F.greatest(high - low + 1, F.lit(0))), low, width)

    low = F.greatest(F.col("start_line"), F.array_min("focus") - EXCERPT_LINES)
    high = F.least(F.col("end_line"), F.array_max("focus") + EXCERPT_LINES)
    first = padded(F.col("start_line"), width)
    gap = F.concat(F.repeat(F.lit(" "), width), F.lit("| …"))
    lead = F.when(low > F.col("start_line"), F.concat(first, F.lit("| "), F.col("signature"), F.lit(" …\n"), gap, F.lit("\n"))).otherwise("")
    tail = F.when(high < F.col("end_line"), F.concat(F.lit("\n"), gap)).otherwise("")
    signature = F.when(F.col("signature") != "", F.col("signature")).otherwise(F.coalesce(trim(F.get("lines", F.col("start_line") - 1)), F.lit("")))
    views = rows.withColumn("excerpt_from", low).withColumn("excerpt_to", high)
    views = views.withColumn("full_text", shown(part(F.col("start_line"), F.col("end_line")), ""))
    views = views.withColumn("excerpt_text", F.when(F.size("focus") > 0, shown(F.concat(lead, part(low, high), tail), ' shown="excerpt around the change"')))
    views = views.withColumn("signature_text", F.when(F.col("lines").isNotNull(), shown(F.concat(first, F.lit("| "), signature, F.lit(" …")), ' shown="signature only"')))
    for name in ("full", "excerpt", "signature"):
        views = views.withColumn(f"{name}_tokens", estimate_tokens(F.col(f"{name}_text")))
    return views.drop("lines")


def choose_views(rows: list[dict], budget: int, most: int) -> list[tuple[int, str | None]]:
    """(seq, mode) of one review's candidates in rank order, mode null for those left out for want of room or content.

    A symbol inside one that is shown whole is passed by. Otherwise the first that fits of: whole, if no larger than
    ``most``; the excerpt, under the same bound; the signature.
    """
    out: list[tuple[int, str | None]] = []
    whole: dict[str, list[tuple[int, int]]] = {}
    for r in rows:
        if any(a <= r["start_line"] and b >= r["end_line"] for a, b in whole.get(r["path"], ())):
            continue
        mode = None
        for name, bound in (("full", most), ("excerpt", most), ("signature", budget)):
            tokens = r[f"{name}_tokens"]
            if tokens is not None and tokens == tokens and tokens <= min(bound, budget):
                mode, budget = name, budget - int(tokens)
                break
        if mode == "full":
            whole.setdefault(r["path"], []).append((r["start_line"], r["end_line"]))
        out.append((r["seq"], mode))
    return out


def assemble(views: DataFrame, limits: DataFrame, keys: list[str]) -> DataFrame:
    """The sections of each review: (keys, seq, gid, path, qualified_name, role, distance, related_to, mode, start_line,
    end_line, text, tokens), with mode null for candidates that were omitted.

    limits: (keys, remaining, max_symbol_tokens). What is shown depends on all that came before it, so each review is one
    sequential pass, over numbers only; texts are joined back afterwards.
    """
    numbers = ["seq", "path", "start_line", "end_line", "full_tokens", "excerpt_tokens", "signature_tokens"]
    small = views.select(*keys, *numbers).join(limits, keys)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        first = pdf.iloc[0]
        chosen = choose_views(pdf[numbers].to_dict("records"), int(first["remaining"]), int(first["max_symbol_tokens"]))
        out = pd.DataFrame(chosen, columns=["seq", "mode"], dtype="object")
        for k in keys:
            out[k] = first[k]
        return out[[*keys, "seq", "mode"]]

    types = {f.name: f.dataType.simpleString() for f in views.schema.fields}
    picked = small.groupBy(*keys).applyInPandas(fold, ", ".join(f"{k} {types[k]}" for k in keys) + ", seq int, mode string")
    out = views.join(picked, [*keys, "seq"])
    by_mode = lambda suffix: F.coalesce(*[F.when(F.col("mode") == m, F.col(f"{m}_{suffix}")) for m in ("full", "excerpt", "signature")])
    cut = F.col("mode") == "excerpt"
    return out.select(
        *keys, "seq", "gid", "path", "qualified_name", "role", "distance", "related_to", "mode",
        F.when(cut, F.col("excerpt_from")).otherwise(F.col("start_line")).alias("start_line"),
        F.when(cut, F.col("excerpt_to")).otherwise(F.col("end_line")).alias("end_line"),
        by_mode("text").alias("text"), by_mode("tokens").alias("tokens"),
    )


def assembly_stats(sections: DataFrame, keys: list[str]) -> DataFrame:
    return sections.groupBy(*keys).agg(
        F.count("mode").alias("included"),
        F.count_if(F.col("mode") == "signature").alias("signature_only"),
        F.count_if(F.col("mode").isNull()).alias("omitted"),
        F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens"),
    )
