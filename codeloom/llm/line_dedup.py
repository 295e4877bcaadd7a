"""Removes lines that many documents share. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, checkpoint, pick, with_row_key


def line_key(line):
    """What makes lines equal: both ends stripped of white space, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def shared_lines(docs: DataFrame, id_col: str = "doc_id", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """The positions of lines to drop: rows (__key, drop array<int>), for documents with any.

    Lines travel as a 128-bit hash, never as text. Counting is by (document, hash) first, so a line repeated within a
    document counts once, and then by hash with partial sums: a line held by a third of all documents reaches its counter
    as one row per task. Both are written, so texts are read once; the join that brings counts back has a single row per
    hash on one side and reads both sides from exchanges of its own, which adaptive execution splits where a hash is hot.
    """
    lines = docs.select("__key", F.col(id_col).alias("__id"), F.posexplode(F.split(F.col("text"), "\n")).alias("pos", "line"))
    lines = lines.withColumn("k", line_key(F.col("line"))).filter(F.char_length("k") >= min_chars)
    held = lines.select("__key", "__id", "pos", F.xxhash64("k").alias("k1"), F.xxhash64(F.lit(1), F.col("k")).alias("k2"))
    held = checkpoint(held.groupBy("k1", "k2", "__key", "__id").agg(F.collect_list("pos").alias("at")))
    counts = checkpoint(held.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("keeper")).filter(F.col("n") >= min_docs))
    lost = held.join(counts, ["k1", "k2"]).filter(F.col("__id").isNull() & F.col("keeper").isNotNull() | (F.col("__id") != F.col("keeper")))
    return lost.groupBy("__key").agg(F.flatten(F.collect_list("at")).alias("drop"))


def _judged(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """The columns of documents but for the text as __c0, __c1, ..., whatever their names, the text left, whether there was
    one, and line counts."""
    names = docs.columns
    inner = docs.toDF(*[f"__c{i}" for i in range(len(names))])
    own, text = f"__c{names.index(id_col)}", f"__c{names.index(text_col)}"
    # from here on the text is held once; whether it was null is all that is asked of the original
    inner = with_row_key(inner.withColumns({"__null": F.col(text).isNull(), "text": F.coalesce(text, F.lit(""))}), own)
    lost = shared_lines(inner, own, min_chars, min_docs)
    joined = inner.join(lost, "__key", "left").withColumn("lines", F.split("text", "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    kept = F.transform(left, lambda i: F.get(F.col("lines"), i))
    new = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    counts = F.size("lines").cast("long").alias("__n"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("__gone")
    return joined.select(*[f"__c{i}" for i in range(len(names)) if f"__c{i}" != text], "__null", new.alias("__left"), *counts)


def keep_own_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """The documents with their columns, whatever else these are called, the text being the lines left and ``chars_col``, if
    there is one, its length; rules as in line_dedup. Documents that lose lines and have no word left go; all others stay,
    those that had no word before among them."""
    judged = _judged(docs, id_col, text_col, min_chars, min_docs)
    judged = judged.filter((F.col("__gone") == 0) | (F.length(F.btrim("__left", F.lit(SPACES))) > 0))
    new = {text_col: F.when(~F.col("__null"), F.col("__left")), chars_col: F.char_length("__left").cast("long")}
    return judged.select(*[(new[n] if n in new else F.col(f"__c{i}")).alias(n) for i, n in enumerate(docs.columns)])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Per document (id, text with the lines left, n_lines before, n_dropped).

    Lines end at ``\\n``; a line's key is the line stripped of white space at both ends and with A-Z lower-cased. Keys of
    at least ``min_chars`` code points held by at least ``min_docs`` documents lose their lines everywhere but in the
    smallest id that holds them, where repeats stay too. Null and empty texts are one empty line. Rows that repeat an id
    are documents of their own which tie for smallest; null ids come after all others. An empty table gives no rows.
    """
    judged = _judged(pick(docs, id_col, text_col), id_col, text_col, min_chars, min_docs)
    return judged.select(F.col("__c0").alias(id_col), F.col("__left").alias(text_col), F.col("__n").alias("n_lines"), F.col("__gone").alias("n_dropped"))
