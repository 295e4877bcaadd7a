"""Repository snapshots as tables: working trees, commits, listings."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.ids import blob_sha
from ..operators.context import MAX_INDEXED
from ..operators.extract import language_of

# The largest file that is read, and folders that a walk doesn't enter.
MAX_READ = 1_000_000
SKIPPED = r"(^|/)(\.git|node_modules)/"
ENTRY = "path string, blob_sha string, size long, content string"


def working_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, blob_sha, size, content) of a folder, read by Spark in parallel.

    Paths are relative to the folder. Only source files up to the index limit get a content address, others a stand-in
    made of their path; content over the read limit is null. Folders of repositories' own data are not entered.
    """
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    prefix = F.regexp_replace(F.lit(base), "^[a-z0-9]+:/*", "/")
    where = F.regexp_replace(F.col("path"), "^[a-z0-9]+:/*", "/")
    rows = files.withColumn("path", F.regexp_replace(F.substring(where, F.char_length(prefix) + 1, F.char_length(where)), "^/+", ""))
    rows = rows.filter(~F.col("path").rlike(SKIPPED))
    addressed = language_of(F.col("path")).isNotNull() & (F.col("length") <= MAX_INDEXED)
    return rows.select(
        "path",
        F.when(addressed, blob_sha(F.col("content"))).otherwise(F.concat(F.lit("unhashed:"), F.col("path"))).alias("blob_sha"),
        F.col("length").alias("size"),
        F.when(F.col("length") <= MAX_READ, F.decode("content", "UTF-8")).alias("content"),
    )


def inside(path: Column) -> Column:
    """Whether a path stays in its root."""
    depth = F.aggregate(
        F.split(path, "/"),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")),
        lambda s, p: F.struct((s["at"] + F.when(p == "..", -1).when((p == "") | (p == "."), 0).otherwise(1)).alias("at"), F.least(s["low"], s["at"] + F.when(p == "..", -1).otherwise(0)).alias("low")),
        lambda s: s["low"],
    )
    return ~path.startswith("/") & (depth >= 0)


def tree_records(listings: DataFrame, text: str = "listing", keys: tuple[str, ...] = ("repo_id", "sha")) -> DataFrame:
    """(keys, path, blob_sha, size) from the text of a recursive, null-separated listing with sizes. Regular files only."""
    record = listings.select(*keys, F.explode(F.split(text, "\x00")).alias("r")).filter(F.col("r").contains("\t"))
    head, path = F.split(F.trim(F.substring_index("r", "\t", 1)), r"\s+"), F.expr("substring(r, instr(r, '\t') + 1)")
    rows = record.select(*keys, head.alias("h"), path.alias("path")).filter((F.get("h", F.lit(1)) == "blob") & (F.get("h", F.lit(0)) != "120000") & F.get("h", F.lit(2)).isNotNull())
    return rows.select(*keys, "path", F.get("h", F.lit(2)).alias("blob_sha"), F.expr("try_cast(get(h, 3) as long)").alias("size"))


def tree_entries(entries: DataFrame) -> DataFrame:
    """Regular files of an API's tree listing (type, mode, path, sha, size, truncated): (path, blob_sha, size, truncated)."""
    return entries.filter("type = 'blob' and mode <> '120000' and path is not null and sha is not null").select("path", F.col("sha").alias("blob_sha"), "size", "truncated")


def readable(content: Column) -> Column:
    """Content as a review reads it: null beyond the read limit."""
    return F.when(F.char_length(content) <= MAX_READ, content)


def read_once(wanted: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """The content of wanted (keys, path), each path looked up once; null where there is none."""
    found = files.select(*keys, "path", readable(F.col("content")).alias("content")).dropDuplicates([*keys, "path"])
    return wanted.select(*keys, "path").distinct().join(found, [*keys, "path"], "left")


def _git(folder: str, *words: str) -> bytes:
    return subprocess.run(["git", "-C", folder, *words], check=True, capture_output=True).stdout


def revision(folder: str, name: str) -> str:
    """The commit that a branch, tag or expression names."""
    return _git(folder, "rev-parse", "--verify", f"{name}^{{commit}}").decode().strip()


def diff_text(folder: str, base: str, head: str) -> str:
    """What head changes since it parted from base."""
    return _git(folder, "diff", "--no-color", "--no-ext-diff", "--no-textconv", f"{base}...{head}").decode(errors="replace")


class Objects:
    """Contents of a repository's objects, over one process that answers in the order of the questions."""

    def __init__(self, folder: str):
        self.process = subprocess.Popen(["git", "-C", folder, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)

    def read(self, name: str) -> str | None:
        """The text of a blob; null for missing and ambiguous names, other kinds, too large or undecodable contents."""
        if "\n" in name:
            return None
        self.process.stdin.write(name.encode() + b"\n")
        self.process.stdin.flush()
        head = self.process.stdout.readline().decode().split()
        if len(head) != 3 or not head[2].isdigit():
            return None
        size = int(head[2])
        body = self.process.stdout.read(size + 1)[:size]
        return body.decode("utf-8", "replace") if head[1] == "blob" and size <= MAX_READ else None

    def close(self) -> None:
        self.process.stdin.close()
        self.process.wait()


class _Part(InputPartition):
    def __init__(self, rows: list[tuple]):
        super().__init__(0)
        self.rows = rows


class _CommitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.sha = revision(self.folder, options.get("revision", "HEAD"))
        self.size = int(options.get("filesPerTask", "2000"))

    def partitions(self) -> list[InputPartition]:
        rows = []
        for record in _git(self.folder, "ls-tree", "-r", "-l", "-z", self.sha).decode(errors="replace").split("\0"):
            head, tab, path = record.partition("\t")
            words = head.split()
            if tab and len(words) >= 4 and words[1] == "blob" and words[0] != "120000":
                rows.append((path, words[2], int(words[3]) if words[3].isdigit() else None))
        return [_Part(rows[i : i + self.size]) for i in range(0, len(rows), self.size)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        objects = Objects(self.folder)
        try:
            for path, sha, size in partition.rows:
                yield path, sha, size, objects.read(sha) if language_known(path) else None
        finally:
            objects.close()


def language_known(path: str) -> bool:
    from ..operators.extract import EXTENSIONS

    return not path.endswith((".d.ts", ".d.mts", ".d.cts")) and any(path.endswith(e) for e in EXTENSIONS)


class CommitSource(DataSource):
    """``spark.read.format("commit").option("revision", ...).load(folder)``: the files of a commit in a repository whose
    folder all executors can reach. Only objects are read, nothing is run; contents are read for source files."""

    @classmethod
    def name(cls) -> str:
        return "commit"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema) -> DataSourceReader:
        return _CommitReader(self.options)


def memory(spark: SparkSession, contents: dict[str, str]) -> DataFrame:
    """A snapshot from a dictionary."""
    rows = spark.createDataFrame(list(contents.items()), "path string, content string")
    return rows.select("path", blob_sha(F.col("content")).alias("blob_sha"), F.octet_length("content").cast("long").alias("size"), "content")
