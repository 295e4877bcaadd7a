"""Lines to symbols: the innermost range, and what a diff changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Lines of a band: a range and a line meet by an equi-join on (file, band), so a long file is many join keys.
BAND = 64


def innermost(lines: DataFrame, spans: DataFrame, keys: list[str], band: int = BAND) -> DataFrame:
    """Adds to (keys, line) the id of the shortest span that contains it; of equals, the one with the largest id; null if
    there is none. spans: (keys, id, start_line, end_line), both ends inside.

    Each span is listed under the bands it touches and each line under its own, so both sides are dealt out by key and
    band and only spans near a line are compared with it.
    """
    wanted = lines.select(*keys, "line").distinct().withColumn("band", F.expr(f"line div {band}"))
    touched = spans.filter("start_line <= end_line").withColumn("band", F.explode(F.sequence(F.expr(f"start_line div {band}"), F.expr(f"end_line div {band}"))))
    inside = wanted.join(touched, [*keys, "band"]).filter("line between start_line and end_line")
    best = inside.groupBy(*keys, "line").agg(F.min_by("id", F.struct(F.col("end_line") - F.col("start_line"), -F.col("id"))).alias("id"))
    return lines.join(best, [*keys, "line"], "left")


def touched_lines(diff: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, line): new-side lines that a diff touches.

    Added lines count themselves. Deletions that no addition answers count the line before them, or at the start of a file
    the line after. diff is operators.diff.diff_lines; all state lives within a hunk, which is one window.
    """
    usable = diff.filter(~F.col("binary") & F.col("new_path").isNotNull())
    hunk = [*keys, "file_seq", "hunk_seq"]
    order = W.partitionBy(*hunk).orderBy("line_seq")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    fallback = F.when(F.col("new_start") > 1, F.col("new_start") - 1)
    marked = usable.withColumn("previous", F.coalesce(F.last("new_line", ignorenulls=True).over(before), fallback))
    marked = marked.withColumn("above", F.lag("type").over(order)).withColumn("below", F.lead("type").over(order))
    after_deletion = (F.col("type") == "context") & (F.col("above") == "del")
    at_end = (F.col("type") == "del") & F.col("below").isNull()
    line = F.when(F.col("type") == "add", F.col("new_line")).when(after_deletion, F.coalesce("previous", "new_line")).when(at_end, F.col("previous"))
    return marked.select(*keys, F.col("new_path").alias("path"), line.alias("line")).filter("line is not null").distinct()


def changed_symbols(diff: DataFrame, symbols: DataFrame, keys: list[str], graph_keys: list[str]) -> DataFrame:
    """(keys, gid, path, qualified_name, kind, lines): symbols that a diff touches, with the touched lines in order. A line
    outside all declarations belongs to its module; files without symbols drop out."""
    lines = touched_lines(diff, keys)
    spans = symbols.filter("kind <> 'module'").select(*graph_keys, "path", F.col("gid").alias("id"), "start_line", "end_line")
    extra = [k for k in keys if k not in graph_keys]
    asked = lines.select(*graph_keys, "path", "line").distinct()
    found = lines.join(innermost(asked, spans, [*graph_keys, "path"]), [*graph_keys, "path", "line"])
    modules = symbols.filter("kind = 'module'").select(*graph_keys, "path", F.col("gid").alias("module"))
    owned = found.join(modules, [*graph_keys, "path"]).withColumn("gid", F.coalesce("id", "module"))
    grouped = owned.groupBy(*graph_keys, *extra, "gid").agg(F.sort_array(F.collect_set("line")).alias("lines"))
    return grouped.join(symbols.select(*graph_keys, "gid", "path", "qualified_name", "kind"), [*graph_keys, "gid"])
