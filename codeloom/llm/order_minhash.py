"""Order MinHash fingerprints of texts. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, pick

#: Words of a k-mer, slots of a signature.
K, SLOTS = 3, 32
#: Symbols are runs of other than ASCII white space, cut every so many code points, so that text without blanks has symbols too.
SYMBOL = r"[^\x20\x09-\x0D]{1,12}"
#: Bits of a k-mer's place in its text, enough for any text that a column can hold, and of the hash in front of it.
PLACE, HASH = 31, 32
#: What tells texts apart and orders them: ids, nulls last, then two hashes of the text.
KEY = ["none", "id", "h1", "h2"]


def bound(value: Column, f) -> Column:
    """f(value), with the value computed once however often f refers to it: a lambda variable holds it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def kmers(text: Column, k: int = K) -> Column:
    """Per run of k symbols the upper bits of its hash and, below them, its place, sorted; a shorter text has one run of all
    it has."""
    places = lambda w: F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0)))
    hashed = lambda w, i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])
    at = lambda w: F.transform(places(w), lambda i: hashed(w, i).bitwiseAND(F.lit(-1 << PLACE)).bitwiseOR(i.cast("long")))
    return F.sort_array(bound(F.regexp_extract_all(text, F.lit(SYMBOL), F.lit(0)), at))


def fingerprint(text: Column, k: int = K, slots: int = SLOTS) -> Column:
    """The signature of a text, an array of ``slots`` (a power of two) hashes.

    Every k-mer is numbered among its like in text order, and k-mer and number are hashed together. A slot takes the two
    least of all numbered k-mers of the text under an order of its own, that of hash XOR slot (in the highest bits). Their
    hashes, in the order in which they stand in the text, make the slot's value. The hash's highest bits deal k-mers to
    buckets, of which two each can be least in any slot; a slot finds them in its own bucket or else in the nearest ones.
    """
    gram = lambda v: F.shiftright(v, PLACE)
    place = lambda v: v.bitwiseAND(F.lit((1 << PLACE) - 1))
    rest = lambda v: F.shiftrightunsigned(v, PLACE)
    top = HASH + PLACE - (slots - 1).bit_length()  # the bits from here on are the bucket

    def number(sorted_: Column, v: Column, i: Column) -> Column:
        # equal k-mers stand side by side: their first is found by steps of halving length
        like = lambda f: F.coalesce(gram(F.get(sorted_, f)) == gram(v), F.lit(False))
        steps = F.filter(F.array(*[F.lit(1 << b) for b in reversed(range(PLACE))]), lambda step: step <= i)
        first = F.aggregate(steps, i, lambda f, step: F.when((f >= step) & like(f - step), f - step).otherwise(f))
        return F.when((i > 0) & like(i - 1), i - first).otherwise(F.lit(0))

    def numbered(sorted_: Column) -> Column:
        low = lambda e: F.shiftleft(e.bitwiseAND(F.lit((1 << HASH) - 1)), PLACE)
        return F.sort_array(F.transform(sorted_, lambda v, i: low(F.xxhash64(gram(v), number(sorted_, v, i))).bitwiseOR(place(v))))

    def least(all_: Column) -> Column:
        return F.filter(all_, lambda x, i: (i < 2) | (F.shiftright(x, top) != F.shiftright(F.get(all_, i - 2), top)))

    def value(a: Column, b: Column) -> Column:
        swap = (place(b) < place(a)) | (place(b) == place(a)) & (b < a)
        return F.when(swap, F.xxhash64(rest(b), rest(a))).otherwise(F.xxhash64(rest(a), rest(b)))

    def signature(own: Column) -> Column:
        # with two k-mers in each bucket they are their slot's; rest() leaves the bucket in, XOR takes it to the slot's order
        masks = F.array(*[F.lit(s << top) for s in range(slots)])
        plain = F.transform(masks, lambda mask, s: value(F.get(own, 2 * s).bitwiseXOR(mask), F.get(own, 2 * s + 1).bitwiseXOR(mask)))
        other = F.transform(masks, lambda mask: bound(F.sort_array(F.transform(own, lambda x: x.bitwiseXOR(mask))), lambda two: value(F.get(two, F.lit(0)), F.get(two, F.lit(1)))))
        return F.when(F.size(own) == 2 * slots, plain).otherwise(other)

    return bound(kmers(text, k), lambda s: bound(numbered(s), lambda a: bound(least(a), signature)))


def likeness(a: Column, b: Column) -> Column:
    """The share of slots in which two signatures agree."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return same / F.size(a)


def printed(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lower(F.hex(x))), ".")


def successors(keys: DataFrame) -> DataFrame:
    """For rows of KEY, each once, (KEY, prev): the key before it in ascending order as a struct; the first has the last.

    Keys are dealt out by ranges that Spark samples, so any distribution of ids gives equal shares, and only the last key
    of a range crosses a border. No text takes part.
    """
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpoint(keys.select(*KEY).repartitionByRange(n, *KEY).withColumn("range", F.spark_partition_id()))
    key = F.struct(*KEY)
    ranges = dealt.groupBy("range").agg(F.max(key).alias("last"))
    along = W.orderBy("range")  # a row per range, whose number is that of the shuffle partitions
    whole = along.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = ranges.select("range", F.coalesce(F.lag("last").over(along), F.last("last").over(whole)).alias("before"))
    ranked = dealt.withColumn("own", F.lag(key).over(W.partitionBy("range").orderBy(*KEY)))
    return ranked.join(before, "range").select(*KEY, F.coalesce("own", "before").alias("prev"))


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, slots: int = SLOTS) -> DataFrame:
    """Per document (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has the last quarter (rounded down, in code points) of a text replaced by as much of the start of the
    following document's text, or all of it if that is shorter. Null texts are empty; empty texts are like each other
    (1.0). A fingerprint is the signature in hexadecimal; equal texts have equal ones. Repeated ids follow each other in
    the order of a hash of their texts, null ids come last. Rows alike in id and text follow each other: all but the last
    of them are followed by their own text. An only document is followed by itself, an empty table gives no rows.

    Texts are dealt out by their keys once. The following document sends the start that the edit needs, at most a quarter
    of the text before it, and its signature to its predecessor; what follows what is found on keys alone.
    """
    docs = pick(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_ = F.coalesce("__id", F.lit(0))
    docs = docs.select(F.col("__id").isNull().alias("none"), id_.alias("id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")
    keys = checkpoint(docs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("rows"), F.max(F.char_length("text")).alias("n")))
    alike = bool(keys.filter("rows > 1").take(1))
    texts = (docs.dropDuplicates(KEY) if alike else docs).withColumn("print", fingerprint(F.col("text"), k, slots))
    cut = lambda c: F.floor(c / 4).cast("int")
    prev = successors(keys)
    # asked: the document before, and how much of this one it takes over
    asked = prev.join(keys.select(F.struct(*KEY).alias("prev"), cut(F.col("n")).alias("need")), "prev")
    heads = texts.join(asked, KEY).select(*[F.col(f"prev.{c}").alias(c) for c in KEY], F.substring("text", F.lit(1), F.col("need")).alias("head"), F.col("print").alias("next"))
    n = F.char_length("text")
    edited = lambda head: F.concat(F.substring("text", F.lit(1), n - cut(n)), head)
    both = texts.join(heads, KEY).withColumn("edited", edited(F.col("head")))
    both = both.select(*KEY, n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "print", fingerprint(F.col("edited"), k, slots).alias("after"), "next")
    if alike:
        more = texts.join(keys.filter("rows > 1").select(*KEY, F.explode(F.sequence(F.lit(2), F.col("rows"))).alias("row")), KEY).drop("row")
        more = more.withColumn("edited", edited(F.substring("text", F.lit(1), cut(n))))
        both = both.unionByName(more.select(*KEY, n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "print", fingerprint(F.col("edited"), k, slots).alias("after"), F.col("print").alias("next")))
    return both.select(
        F.when(~F.col("none"), F.col("id")).alias(id_col),
        "n_chars",
        "edited_sha256",
        printed(F.col("print")).alias("fingerprint"),
        printed(F.col("after")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("after")).alias("near_edited"),
        likeness(F.col("print"), F.col("next")).alias("near_next"),
    )
