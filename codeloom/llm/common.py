"""What the corpus operators share: column picking, row keys, checkpoints and graph components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words and are stripped from lines: blank, and 0x09 to 0x0D.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly these columns, by exact name: columns that differ in case only are told apart."""
    have = df.columns
    plain = df.toDF(*[f"__c{i}" for i in range(len(have))])
    return plain.select(*[F.col(f"__c{have.index(n)}").alias(n) for n in names])


def map_rows(df: DataFrame, run) -> DataFrame:
    """mapInArrow with a function that keeps the columns, whatever their names."""
    plain = df.toDF(*[f"__c{i}" for i in range(len(df.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def ascii_lower(column):
    """A-Z lower-cased, all else unchanged. Pure ASCII takes the fast built-in."""
    return F.when(F.octet_length(column) == F.char_length(column), F.lower(column)).otherwise(F.translate(column, UPPER, LOWER))


def with_row_key(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = "__key") -> DataFrame:
    """Adds a bigint that tells rows apart: the id itself where ids are unique and not null, which one cheap pass over the
    id column decides; else a number that only rows alike in id and text share (and get equal results by). Numbers are given
    to groups by id and 128 bits of hashes of the text, in a written table, and joined back."""
    ids = df.agg(F.count(F.lit(1)).alias("n"), F.count(id_col).alias("set"))
    again = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1)
    counted = ids.first()
    if counted["n"] == counted["set"] and not again.take(1):
        # not null by type, or inner joins would filter by it and not read the same exchange as outer ones
        return df.withColumn(key, F.coalesce(F.col(id_col).cast("long"), F.lit(0)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = {"__i": F.col(id_col), "__h1": F.xxhash64(text), "__h2": F.xxhash64(F.lit(1), text)}
    groups = checkpoint(df.select(*[c.alias(f"{n}_") for n, c in own.items()]).distinct().withColumn(key, F.monotonically_increasing_id()))
    same = F.col("__i").eqNullSafe(F.col("__i_")) & (F.col("__h1") == F.col("__h1_")) & (F.col("__h2") == F.col("__h2_"))
    return df.withColumns(own).join(groups, same).drop(*own, *[f"{n}_" for n in own])


def checkpoint_folder(spark: SparkSession) -> None:
    """Sets the folder for checkpoints that the cluster names in ``spark.checkpoint.dir``, which all executors share. Only a
    local session without one, as in tests, gets a folder of its own; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with files in the checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Stored(NamedTuple):
    """Rows in a folder of their own beside the checkpoints, as Parquet: far smaller there than checkpoints are."""

    rows: DataFrame
    path: str

    def remove(self) -> None:
        """Removes the folder through the file system that Spark reads it by. Nothing may read the rows afterwards."""
        spark = self.rows.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame, name: str = "rows") -> Stored:
    """Writes the rows, which cuts the lineage, and reads them again; the folder's name is new each time."""
    spark = df.sparkSession
    checkpoint_folder(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return Stored(spark.read.schema(df.schema).parquet(path), path)


def once(keyed: DataFrame, key: str = "__key") -> tuple[DataFrame, DataFrame | None]:
    """One row of each key, and how many each has (__rows) if some have more than one."""
    rows = keyed.groupBy(key).agg(F.count(F.lit(1)).alias("__rows"))
    return (keyed.dropDuplicates([key]), rows) if rows.filter("__rows > 1").take(1) else (keyed, None)


def settle(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of rounds that are over, and their checkpoint files where the session sets
    spark.cleaner.referenceTracking.cleanCheckpoints. It does so when the driver's garbage is collected, and a driver that
    only starts small jobs has little garbage and would keep the files for long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    ``links`` has two bigint columns; the result has a row (node, root) for each node in a link, root being the smallest
    node of its component. Every step is two shuffles of at most as many rows as there are links, and a node with many
    neighbours is reduced by partial aggregation, never collected. Rounds go on until nothing changes; their number grows
    with the logarithm of the longest path. No links give no rows.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = checkpoint(edges), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        edges = checkpoint(small.select("e.u", "e.v").filter("u <> v").distinct())
        after = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if after == before:
            break
        before = after
        settle(links.sparkSession)
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
