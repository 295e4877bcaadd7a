"""Cleans and mixes a corpus in five stages, each an operator of ``codeloom.llm`` on all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import decontaminate, language, line_dedup, mixing, near_dedup
from codeloom.llm.common import stored, table

#: Share of a document's letters that must be in its main language.
LEAST_SCORE = 0.2


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those of which no language holds a fifth of the letters. Null and empty texts
    have no letter; without any labelled text all documents stay. Equal rows share their fate; an empty table stays empty."""
    return language.keep_identified(docs, language.train(docs), LEAST_SCORE)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that an earlier document has; n_chars follows the text. Documents of which nothing is left go, all others
    stay, null and empty texts too. Rows that repeat an id tie and keep their lines; null ids come last."""
    return line_dedup.keep_own_lines(docs, min_chars=10, min_docs=2)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by 0.8 of their five-word shingles, the one with the smallest id. Texts without
    words and null ids stay; of rows that repeat an id all stay or none."""
    return near_dedup.keep_one(docs, n=5, percent=80)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents with ten words in a row of a benchmark item, or all words of a shorter one. Null texts stay, and so
    do all with an empty benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources meet their weights; ``copy`` numbers a document's copies (``_copy`` if
    documents have a column of that name). Texts without words are no part of a mix. Null sources are a source; rows alike
    in id, source and text are one document with the copies of all."""
    name = "copy"
    while name in map(str.lower, docs.columns):
        name = f"_{name}"
    return mixing.drawn(docs, copy_col=name)


STAGES = [
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing to target weights", mixing_stage),
]

#: Language models, similarity groups and random rounding have no SQL form; the tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next. A stage's rows are removed when the next
    stage's are written; those that the last one reads stay in the checkpoint folder, since the result is read from them."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        now = stored(stage(spark, docs, sf_dir), f"corpus-{name.replace(' ', '-')}")
        if before:
            before.remove()
        docs, before = now.rows, now
    return STAGES[-1][1](spark, docs, sf_dir)
