"""Model comments: checked against the change, de-duplicated, ranked and capped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import comment_body, jaccard, normalize_code, normalize_evidence, normalize_path, trim, words

# Categories, severities in order, and when two comments say the same.
CATEGORIES = ("bug", "security", "performance", "error-handling", "concurrency", "api-misuse", "maintainability", "testing")
SEVERITIES = ("critical", "high", "medium", "low")
LINE_WINDOW = 3
CLAIM_SIMILARITY = 0.5
SCHEMA_NAME = "review-comments/v1"
COMMENT = "file string, line int, category string, severity string, claim string, evidence string, suggested_fix string, confidence double"


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity) - 1


def file_index(lines: DataFrame, heads: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, haystack): all lines of a file's diff, either side, and its head, with white space collapsed."""
    parts = lines.groupBy(*keys, F.col("new_path").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_seq", "hunk_seq", "line_seq", "content"))), lambda x: x["content"]), "\n").alias("diff"))
    return parts.join(heads, [*keys, "path"], "left").select(*keys, "path", normalize_code(F.concat(F.col("diff"), F.lit("\n"), F.coalesce("content", F.lit("")))).alias("haystack"))


def commentable(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, line): new-side lines of a diff, which can carry comments."""
    return lines.filter("type <> 'del' and new_line is not null").select(*keys, F.col("new_path").alias("path"), F.col("new_line").alias("line")).distinct()


def reject_reason(file_known: Column, line_known: Column, claim: Column, confidence: Column, evidence: Column, haystack: Column) -> Column:
    """The first rule that a comment breaks, or null."""
    return (
        F.when(~file_known, "file_not_in_diff")
        .when(~line_known, "line_not_in_diff")
        .when(trim(claim) == "", "empty_claim")
        .when((confidence < 0) | (confidence > 1), "confidence_out_of_range")
        .when((F.char_length(evidence) < 2) | ~F.contains(haystack, evidence), "evidence_not_found")
    )


def validate(comments: DataFrame, lines: DataFrame, heads: DataFrame, keys: list[str]) -> DataFrame:
    """Adds reject_reason to comments and normalises their file. lines and heads are those of reviewable files; checks are
    the same whatever the model was shown."""
    out = comments.withColumn("file", normalize_path(F.col("file")))
    index = file_index(lines, heads, keys).select(*keys, F.col("path").alias("file"), "haystack")
    spots = commentable(lines, keys).select(*keys, F.col("path").alias("file"), "line", F.lit(True).alias("__spot"))
    out = out.join(index, [*keys, "file"], "left").join(spots, [*keys, "file", "line"], "left")
    reason = reject_reason(F.col("haystack").isNotNull(), F.coalesce("__spot", F.lit(False)), F.col("claim"), F.col("confidence"), normalize_evidence(F.col("evidence")), F.col("haystack"))
    return out.withColumn("reject_reason", reason).drop("haystack", "__spot")


def same(a: Column, b: Column) -> Column:
    """Whether two comments (structs with file, line, category and words) are near duplicates."""
    near = (a["file"] == b["file"]) & (F.abs(a["line"] - b["line"]) <= LINE_WINDOW)
    return near & (((a["line"] == b["line"]) & (a["category"] == b["category"])) | (jaccard(a["words"], b["words"]) >= CLAIM_SIMILARITY))


def near_pairs(comments: DataFrame, keys: list[str], index: str = "index") -> DataFrame:
    """All near-duplicate pairs (keys, a, b), a before b. Comments meet in the band of their line or the next one, by an
    equi-join on file and band, not by a comparison of all with all."""
    rows = comments.select(*keys, F.col(index).alias("i"), "file", "line", "category", words(F.col("claim")).alias("words"))
    band = F.expr(f"line div {LINE_WINDOW + 1}")
    left = rows.withColumn("band", F.explode(F.array(band - 1, band, band + 1))).alias("x")
    right = rows.withColumn("band", band).alias("y")
    on = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in [*keys, "file", "band"]]
    one, two = (F.struct(*[F.col(f"{t}.{c}").alias(c) for c in ("file", "line", "category", "words")]) for t in "xy")
    return left.join(right, [*on, F.col("x.i") < F.col("y.i"), same(one, two)]).select(*[F.col(f"x.{k}") for k in keys], F.col("x.i").alias("a"), F.col("y.i").alias("b"))


def find_duplicates(comments: DataFrame, keys: list[str], index: str = "index") -> DataFrame:
    """(keys, index, position, duplicate_of): comments in order of priority; each that is near one kept before it names the
    first such, else it is kept itself and position counts the kept.

    Priority: severity, confidence descending, file in locale order, line, index. What is kept depends on what was kept
    before, so a review's comments are one fold over a sorted array: a model's answer, dozens of small structs.
    """
    row = F.struct(
        severity_rank(F.col("severity")).alias("rank"),
        (-F.col("confidence")).alias("doubt"),
        F.collate("file", "UNICODE").alias("place"),
        F.col("line").alias("line"),
        F.col(index).cast("int").alias("index"),
        "file",
        "category",
        words(F.col("claim")).alias("words"),
    )
    listed = comments.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("c"))
    slim = F.transform("c", lambda x: F.struct(x["index"].alias("index"), x["file"].alias("file"), x["line"].alias("line"), x["category"].alias("category"), x["words"].alias("words")))
    kind = "array<struct<index:int,file:string,line:int,category:string,words:array<string>>>"
    start = F.struct(F.array().cast(kind).alias("kept"), F.array().cast("array<struct<index:int,position:int,duplicate_of:int>>").alias("out"))

    def offer(state: Column, x: Column) -> Column:
        first = F.get(F.filter(state["kept"], lambda k: same(k, x)), F.lit(0))["index"]
        kept = F.when(first.isNull(), F.concat(state["kept"], F.array(x))).otherwise(state["kept"])
        row = F.struct(x["index"].alias("index"), F.when(first.isNull(), F.size(state["kept"]) + 1).alias("position"), first.alias("duplicate_of"))
        return F.struct(kept.alias("kept"), F.concat(state["out"], F.array(row)).alias("out"))

    folded = listed.withColumn("s", slim).select(*keys, F.inline(F.aggregate("s", start, offer, lambda s: s["out"])))
    return folded.withColumnRenamed("index", index)


def decide(comments: DataFrame, cap: Column, keys: list[str]) -> DataFrame:
    """Candidates with status, reject_reason, duplicate_of, rank and body: invalid, duplicate, selected, or over_cap beyond
    the first ``cap`` of a review."""
    found = find_duplicates(comments.filter("reject_reason is null"), keys)
    out = comments.join(found, [*keys, "index"], "left").withColumnRenamed("position", "rank")
    status = F.when(F.col("reject_reason").isNotNull(), "invalid").when(F.col("duplicate_of").isNotNull(), "duplicate").when(F.col("rank") <= cap, "selected").otherwise("over_cap")
    body = comment_body(F.col("category"), F.col("severity"), F.col("claim"), F.col("evidence"), F.col("suggested_fix"))
    return out.withColumn("status", status).withColumn("body", body)


def selected(candidates: DataFrame, keys: list[str]) -> DataFrame:
    return candidates.filter("status = 'selected'").withColumn("seq", F.row_number().over(W.partitionBy(*keys).orderBy("rank")) - 1)


def status_counts(candidates: DataFrame, keys: list[str]) -> DataFrame:
    return candidates.groupBy(*keys, "status").agg(F.count(F.lit(1)).alias("n"))
