"""Queries over the driver's tables, each with its SQL. The tables hold no diffs or source code, so inputs are derived from
them row by row; every query reads its tables whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ids, scrub, text, timing
from ..operators import comments, context, diff, extract, graph, link, model_calls, ranges, store
from ..sources import trees
from ..streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- files, addresses, caches

_PATH = "'site' || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1), '/+$', '')"
_SUFFIX = "CASE page_id % 8 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' WHEN 2 THEN '.mjs' WHEN 3 THEN '.d.ts' WHEN 4 THEN '.min.js' WHEN 5 THEN '.py' WHEN 6 THEN '.cjs' ELSE '/dist/x.js' END"


@query(f"""
    WITH p AS (SELECT page_id, {_PATH} || {_SUFFIX} AS path, strlen(html) * 40 AS size FROM pages),
    l AS (SELECT *, CASE WHEN regexp_matches(path, '\\.d\\.[mc]?ts$') THEN NULL WHEN regexp_matches(path, '\\.tsx$') THEN 'tsx'
        WHEN regexp_matches(path, '\\.[mc]?ts$') THEN 'typescript' WHEN regexp_matches(path, '\\.([mc]?js|jsx)$') THEN 'javascript' END AS language FROM p)
    SELECT page_id, path, language, language IS NOT NULL AND NOT regexp_matches(path, '(^|/)(node_modules|dist|build|out|coverage|vendor|\\.git|\\.next|\\.turbo)/')
        AND NOT regexp_matches(path, '\\.min\\.[cm]?js$') AND size <= 512000 AS indexable FROM l""")
def q_indexable(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rows = pages.select("page_id", F.expr(f"concat({_PATH.replace(' || ', ', ')}, {_SUFFIX})").alias("path"), (F.octet_length("html") * 40).alias("size"))
    path = F.col("path")
    return rows.select("page_id", "path", extract.language_of(path).alias("language"), context.is_indexable(path, F.col("size")).alias("indexable"))


@query("SELECT doc_id, sha1('blob ' || strlen(text) || chr(0) || text) AS blob_sha FROM documents")
def q_blob_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ids.blob_sha(F.col("text")).alias("blob_sha"))


@query("""
    WITH b AS (SELECT source, doc_id, row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_id) AS n FROM documents)
    SELECT source, count(*) FILTER (n = 1) AS parsed, count(*) FILTER (n > 1) AS from_cache FROM b GROUP BY source""")
def q_parse_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", ids.blob_sha(F.col("text")).alias("key"))
    first = docs.groupBy("key").agg(F.min("doc_id").alias("first"))
    seen = docs.join(first, "key")
    return seen.groupBy("source").agg(F.count_if(F.col("doc_id") == F.col("first")).alias("parsed"), F.count_if(F.col("doc_id") != F.col("first")).alias("from_cache"))


@query("""
    WITH l AS (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS lines FROM documents),
    u AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS n, len(lines) AS total FROM l)
    SELECT doc_id, n, lpad(n::VARCHAR, strlen(total::VARCHAR)::INT, ' ') || '| ' || line AS shown FROM u""")
def q_numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text.file_lines(F.col("text")).alias("lines"))
    rows = docs.select("doc_id", F.size("lines").alias("total"), F.posexplode("lines").alias("i", "line"))
    number = F.col("i") + 1
    return rows.select("doc_id", number.cast("long").alias("n"), F.concat(text.padded(number, F.char_length(F.col("total").cast("string"))), F.lit("| "), F.col("line")).alias("shown"))


@query("""
    WITH r AS (SELECT source, string_agg('100644 blob ' || sha1(text) || ' ' || strlen(text) || chr(9) || 'docs/' || doc_id || '.txt', chr(0) ORDER BY doc_id) FROM documents GROUP BY source)
    SELECT source, 'docs/' || doc_id || '.txt' AS path, sha1(text) AS blob_sha, strlen(text) AS size FROM documents""")
def q_tree_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    record = F.concat(F.lit("100644 blob "), F.sha1("text"), F.lit(" "), F.octet_length("text").cast("string"), F.lit("\tdocs/"), F.col("doc_id").cast("string"), F.lit(".txt\0"))
    link_ = F.concat(F.lit("120000 blob "), F.sha1("text"), F.lit(" 9\tlinks/"), F.col("doc_id").cast("string"), F.lit("\0040000 tree "), F.sha1("text"), F.lit(" -\tdir\0"))
    listings = docs.withColumn("part", F.expr("doc_id div 1000")).groupBy("source", "part").agg(F.array_join(F.collect_list(F.concat(record, link_)), "").alias("listing"))
    return trees.tree_records(listings, keys=("source",))


# ---- graphs

_KIND = "CASE l_returnflag WHEN 'A' THEN 'calls' WHEN 'N' THEN 'imports' ELSE 'extends' END"
_AT = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"
_EDGES = f"""
    e AS (SELECT l_suppkey % 10 AS repo_id, l_suppkey AS src, l_partkey AS dst, {_KIND} AS kind, row({_AT}) AS place FROM lineitem WHERE l_suppkey <> l_partkey),
    d AS (SELECT repo_id, src, dst, kind, min(place) AS place FROM e GROUP BY ALL),
    edges AS (SELECT repo_id, src, dst, kind, row_number() OVER (PARTITION BY repo_id ORDER BY place, src, dst, kind) - 1 AS seq FROM d)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    at = F.struct(*[x.strip() for x in _AT.split(",")])
    raw = items.select((F.col("l_suppkey") % 10).alias("repo_id"), F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.expr(_KIND).alias("kind"), at.alias("at"))
    return link.distinct_edges(raw, ["repo_id"])


@query(f"WITH {_EDGES} SELECT * FROM edges")
def q_edges_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).withColumn("seq", F.col("seq").cast("long"))


@query(f"""
    WITH {_EDGES}, s AS (SELECT DISTINCT repo_id, dst AS gid FROM edges),
    c AS (SELECT s.repo_id, s.gid, count(e.src) AS n FROM s LEFT JOIN edges e ON e.repo_id = s.repo_id AND e.dst = s.gid AND e.kind = 'calls' GROUP BY ALL)
    SELECT repo_id, gid, n, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, gid) AS rank FROM c QUALIFY rank <= 10""")
def q_most_called(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    symbols = edges.select("repo_id", F.col("dst").alias("gid"), F.lit("function").alias("kind")).distinct()
    return graph.most_called(symbols, edges, ["repo_id"]).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_EDGES} SELECT repo_id, count(*) AS edges, count(*) FILTER (kind = 'calls') AS calls, count(*) FILTER (kind = 'imports') AS imports, count(*) FILTER (kind = 'extends') AS extends FROM edges GROUP BY repo_id")
def q_edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_kind = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return _edges(spark, sf_dir).groupBy("repo_id").agg(F.count(F.lit(1)).alias("edges"), is_kind("calls"), is_kind("imports"), is_kind("extends"))


@query("SELECT p_brand, p_type AS kind, count(*) AS n FROM part GROUP BY ALL")
def q_kind_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.kind_histogram(table(spark, sf_dir, "part").withColumnRenamed("p_type", "kind"), ["p_brand"])


_HOPS = """
    one AS (SELECT DISTINCT o_custkey AS seed, 10000000 + l_partkey AS node FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
    up AS (SELECT DISTINCT 10000000 + l_partkey AS node, 20000000 + l_suppkey AS next FROM lineitem),
    walked AS (SELECT seed, node, 1 AS distance FROM one UNION ALL SELECT DISTINCT seed, next, 2 FROM one JOIN up USING (node))"""


def _walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    bought = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), (F.col("l_partkey") + 10_000_000).alias("dst"), F.lit("calls").alias("kind"))
    made = items.select((F.col("l_partkey") + 10_000_000).alias("src"), (F.col("l_suppkey") + 20_000_000).alias("dst"), F.lit("extends").alias("kind"))
    edges = bought.unionByName(made).distinct().withColumn("seq", F.xxhash64("src", "dst"))
    starts = orders.select(F.col("o_custkey").alias("seed"), F.col("o_custkey").alias("node"), F.lit(0).cast("long").alias("pos")).distinct()
    return graph.walk(starts, edges, 2, ["seed"], [], last_places=False)


@query(f"WITH {_HOPS} SELECT * FROM walked")
def q_bfs_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walked(spark, sf_dir).select("seed", "node", "distance")


@query(f"WITH {_HOPS} SELECT node, count(DISTINCT seed) AS fan_in FROM walked GROUP BY node")
def q_fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walked(spark, sf_dir).groupBy("node").agg(F.countDistinct("seed").alias("fan_in"))


_ROLE = "CASE l_returnflag WHEN 'A' THEN 'callee' WHEN 'N' THEN 'base' ELSE 'caller' END"
_OFFER_ORDER = "l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_partkey, l_returnflag, l_shipdate"


@query(f"""
    WITH o AS (SELECT l_suppkey AS review_id, l_partkey % 200 AS gid, {_ROLE} AS role, l_linenumber % 3 + 1 AS distance, l_orderkey AS seed,
        row_number() OVER (PARTITION BY l_suppkey, l_partkey % 200 ORDER BY l_linenumber % 3 + 1, CASE {_ROLE} WHEN 'caller' THEN 2 ELSE 1 END, {_OFFER_ORDER}) AS r FROM lineitem)
    SELECT review_id, gid, max(role) FILTER (r = 1) AS role, max(distance) FILTER (r = 1) AS distance, max(seed) FILTER (r = 1) AS seed, count(DISTINCT seed) AS fan_in FROM o GROUP BY ALL""")
def q_best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    offers = items.select(F.col("l_suppkey").alias("review_id"), (F.col("l_partkey") % 200).alias("gid"), F.expr(_ROLE).alias("role"), (F.col("l_linenumber") % 3 + 1).alias("distance"), F.col("l_orderkey").alias("seed"), F.struct(*[x.strip() for x in _OFFER_ORDER.split(",")]).alias("order"))
    return graph.best_offers(offers, ["review_id"]).drop("order")


# ---- ranges and modules

_C = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1"


def _set_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments: a review per order, one comment per line item."""
    items = table(spark, sf_dir, "lineitem")
    index = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")) - 1
    claim = F.concat_ws(" ", F.lit("flag"), "l_returnflag", "l_linestatus", F.concat(F.lit("q"), (F.round("l_quantity").cast("int") % 5).cast("string")), F.concat(F.lit("d"), (F.round(F.col("l_discount") * 100).cast("int") % 3).cast("string")))
    return items.select(
        F.col("l_orderkey").alias("review_id"), index.alias("index"), F.lit("src/a.ts").alias("file"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("category"), claim.alias("claim"),
        F.element_at(F.array(*[F.lit(s) for s in comments.SEVERITIES]), (F.round(F.col("l_tax") * 100).cast("int") % 4) + 1).alias("severity"), (F.col("l_tax") * 20).alias("confidence"), "l_suppkey", "l_quantity",
    )


_SET_C = f"""
    c AS (SELECT l_orderkey AS review_id, {_C} AS index, l_linenumber AS line, l_returnflag AS category,
        'flag ' || l_returnflag || ' ' || l_linestatus || ' q' || (round(l_quantity)::INT % 5) || ' d' || (round(l_discount * 100)::INT % 3) AS claim,
        round(l_tax * 100)::INT % 4 AS rank, l_tax * 20 AS confidence, l_suppkey, l_quantity FROM lineitem),
    w AS (SELECT *, list_distinct(regexp_extract_all(lower(claim), '[a-z0-9_]+')) AS words FROM c),
    pairs AS (SELECT x.review_id, x.index AS a, y.index AS b FROM w x JOIN w y ON x.review_id = y.review_id AND x.index < y.index AND abs(x.line - y.line) <= 3
        AND (x.line = y.line AND x.category = y.category OR len(list_intersect(x.words, y.words)) / len(list_distinct(list_concat(x.words, y.words))) >= 0.5))"""


@query(f"""
    WITH s AS (SELECT l_orderkey AS review_id, {_C} AS id, l_linenumber * 3 AS a, l_linenumber * 3 + round(l_quantity)::INT AS b FROM lineitem),
    p AS (SELECT review_id, unnest(range(1, max(b) + 1)) AS line FROM s GROUP BY review_id),
    m AS (SELECT p.review_id, p.line, id FROM p LEFT JOIN s ON s.review_id = p.review_id AND line BETWEEN a AND b
        QUALIFY row_number() OVER (PARTITION BY p.review_id, line ORDER BY b - a, id DESC) = 1)
    SELECT review_id, line::INT AS line, id::INT AS id FROM m""")
def q_innermost_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _set_c(spark, sf_dir)
    start = F.col("line") * 3
    spans = rows.select("review_id", F.col("index").alias("id"), start.alias("start_line"), (start + F.round("l_quantity").cast("int")).alias("end_line"))
    lines = spans.groupBy("review_id").agg(F.max("end_line").alias("last")).select("review_id", F.explode(F.sequence(F.lit(1), F.col("last"))).alias("line"))
    return ranges.innermost(lines, spans, ["review_id"])


_OPS = """
    o AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'purchase' THEN 'add' WHEN 'error' THEN 'del' ELSE 'context' END AS type FROM events),
    n AS (SELECT user_id, row_number() OVER u AS i, type, CASE WHEN type <> 'del' THEN sum(CASE WHEN type <> 'del' THEN 1 ELSE 0 END) OVER (u ROWS UNBOUNDED PRECEDING) END AS new_line,
        lag(type) OVER u AS above, lead(type) OVER u AS below FROM o WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
    p AS (SELECT *, last_value(new_line IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM n),
    t AS (SELECT DISTINCT user_id, CASE WHEN type = 'add' THEN new_line WHEN type = 'context' AND above = 'del' THEN coalesce(previous, new_line) WHEN type = 'del' AND below IS NULL THEN previous END AS line FROM p)"""


@query(f"""
    WITH {_OPS}, k AS (SELECT unnest(range(0, 40)) AS k), s AS (SELECT k + 1 AS id, 2 + 7 * k AS a, 7 + 7 * k + (k % 3) * 9 AS b FROM k),
    f AS (SELECT user_id, line, coalesce(id, 0) AS gid FROM t LEFT JOIN s ON line BETWEEN a AND b WHERE line IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, line ORDER BY b - a, id DESC) = 1)
    SELECT user_id, gid::INT AS gid, string_agg(line::BIGINT::VARCHAR, ',' ORDER BY line) AS lines FROM f GROUP BY ALL""")
def q_changed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "add").when(F.col("event_type") == "error", "del").otherwise("context")
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    shown = F.when(F.col("type") != "del", 1).otherwise(0)
    lines = events.withColumn("type", kind).withColumn("line_seq", F.row_number().over(order)).withColumn("__n", F.sum(shown).over(order.rowsBetween(W.unboundedPreceding, 0)))
    lines = lines.select("user_id", F.lit(0).alias("file_seq"), F.lit(0).alias("hunk_seq"), "line_seq", "type", F.when(F.col("type") != "del", F.col("__n")).cast("int").alias("new_line"), F.lit(1).alias("new_start"), F.lit(False).alias("binary"), F.lit("log.ts").alias("new_path"))
    users = events.select("user_id").distinct()
    k = F.col("k")
    spans = users.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(39)))).select("user_id", (k + 1).alias("gid"), F.lit("function").alias("kind"), (7 * k + 2).alias("start_line"), (7 * k + 7 + (k % 3) * 9).alias("end_line"))
    modules = users.select("user_id", F.lit(0).alias("gid"), F.lit("module").alias("kind"), F.lit(1).alias("start_line"), F.lit(1 << 30).alias("end_line"))
    symbols = spans.unionByName(modules).withColumn("path", F.lit("log.ts")).withColumn("qualified_name", F.col("gid").cast("string"))
    found = ranges.changed_symbols(lines, symbols, ["user_id"], ["user_id"])
    return found.select("user_id", "gid", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


_EXT = "CASE p_partkey % 5 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' WHEN 2 THEN '/index.ts' WHEN 3 THEN '.js' ELSE '.py' END"


@query(f"""
    WITH f AS (SELECT 'src/p' || p_partkey || {_EXT} AS path FROM part),
    w AS (SELECT DISTINCT 'src/main' || l_suppkey || '.ts' AS path, './p' || l_partkey || CASE WHEN l_linenumber % 2 = 1 THEN '.js' ELSE '' END AS source FROM lineitem),
    b AS (SELECT path, source, 'src/' || source[3:] AS base FROM w),
    c AS (SELECT path, source, unnest([base] || CASE WHEN ends_with(base, '.js') THEN [base[:-4] || '.ts', base[:-4] || '.tsx'] ELSE []::VARCHAR[] END
        || list_transform(['.ts', '.tsx', '.mts', '.cts', '.js', '.jsx', '.mjs', '.cjs'], lambda e: base || e) || list_transform(['.ts', '.tsx', '.mts', '.cts', '.js', '.jsx', '.mjs', '.cjs'], lambda e: base || '/index' || e)) AS target,
        generate_subscripts([base] || CASE WHEN ends_with(base, '.js') THEN [base[:-4] || '.ts', base[:-4] || '.tsx'] ELSE []::VARCHAR[] END || range(16)::VARCHAR[], 1) AS rank FROM b)
    SELECT c.path, source, arg_min(target, rank) AS target FROM c JOIN f ON f.path = target GROUP BY ALL""")
def q_module_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "part").select(F.expr(f"concat('src/p', p_partkey, {_EXT})").alias("path"))
    odd = F.when(F.col("l_linenumber") % 2 == 1, ".js").otherwise("")
    wanted = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("src/main"), "l_suppkey", F.lit(".ts")).alias("path"), F.concat(F.lit("./p"), "l_partkey", odd).alias("source"))
    return link.resolve_modules(wanted, files, [])


def _parse(symbols: str, imports: str = "array()", again: str = "array()", calls: str = "array()", heritage: str = "array()"):
    """A parse struct from SQL expressions of its arrays."""
    return F.expr(f"named_struct('parser_version', 2, 'language', 'typescript', 'line_count', 3, 'symbols', {symbols}, 'imports', {imports}, 're_exports', {again}, 'local_exports', array(), 'calls', {calls}, 'heritage', {heritage}, 'skipped_calls', 0)").cast(extract.PARSE)


_MODULE = "named_struct('id', 0, 'name', '<module>', 'qualified_name', '<module>', 'kind', 'module', 'start_line', 1, 'end_line', 3, 'signature', '', 'exported', false, 'parent', cast(null as int))"


@query("""
    WITH RECURSIVE r(file, up, depth) AS (SELECT c_custkey, c_custkey, 0 FROM customer UNION ALL SELECT file, up // 2, depth + 1 FROM r WHERE depth < 8 AND up >= 1),
    k AS (SELECT r.* FROM r JOIN customer ON c_custkey = up)
    SELECT file, up % 7 AS name, arg_min(up, depth) AS owner FROM k GROUP BY ALL""")
def q_reexport_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "named_struct('id', 1, 'name', concat('n', c_custkey % 7), 'qualified_name', concat('n', c_custkey % 7), 'kind', 'variable', 'start_line', 1, 'end_line', 1, 'signature', '', 'exported', true, 'parent', 0)"
    star = "array(named_struct('exported', '*', 'imported', '*', 'source', concat('./f', c_custkey div 2)))"
    files = table(spark, sf_dir, "customer").select(F.lit(0).alias("repo_id"), F.concat(F.lit("f"), "c_custkey", F.lit(".ts")).alias("path"), _parse(f"array({_MODULE}, {own})", again=star).alias("parse"))
    keys = ["repo_id"]
    symbols = link.checkpoint(link.number_symbols(files, keys))
    tops = symbols.filter("parent = 0").select(*keys, "path", "name", "gid")
    wanted = files.select(*keys, "path", F.explode("parse.re_exports").alias("e")).select(*keys, "path", "e.source")
    modules = link.resolve_modules(wanted, files, keys)
    none = modules.select(*keys, "path", F.lit("").alias("local"), F.lit("").alias("imported"), "target").filter("false")
    exports = link.export_table(keys, files, tops, symbols, modules, none)
    number = lambda c: F.regexp_extract(c, "[0-9]+", 0).cast("long")
    owner = symbols.select(*keys, "gid", F.col("path").alias("owner_path"))
    return exports.join(owner, [*keys, "gid"]).select(number("path").alias("file"), number("name").alias("name"), number("owner_path").alias("owner"))


@query("""
    WITH m AS (SELECT s_nationkey AS owner, s_suppkey % 5 AS member, min(s_suppkey) AS gid FROM supplier GROUP BY ALL),
    x AS (SELECT n_nationkey AS owner, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS super FROM nation),
    a AS (SELECT owner, super, unnest(range(0, 5)) AS member FROM x)
    SELECT a.owner::INT AS owner, a.member, coalesce(m.gid, b.gid) AS method_gid FROM a LEFT JOIN m ON m.owner = a.owner AND m.member = a.member LEFT JOIN m b ON b.owner = a.super AND b.member = a.member""")
def q_method_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("owner"), (F.col("s_suppkey") % 5).alias("member")).agg(F.min("s_suppkey").alias("gid"))
    nations = table(spark, sf_dir, "nation")
    extends = nations.join(nations.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("super")), "n_regionkey").select(F.col("n_nationkey").alias("owner"), "super")
    asked = nations.select(F.col("n_nationkey").alias("owner"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("member"))
    return link.method_of(asked, children, extends, []).select("owner", "member", "method_gid")


@query("""
    WITH f AS (SELECT p_partkey AS k, p_partkey // 2 AS up FROM part), e AS (SELECT k, up FROM f WHERE up IN (SELECT k FROM f))
    SELECT 'p' || k || '.ts:<module>' AS src, 'p' || up || '.ts:f' || up AS dst, 'imports' AS kind FROM e
    UNION ALL SELECT 'p' || k || '.ts:f' || k, 'p' || up || '.ts:f' || up, 'calls' FROM e WHERE k <> up
    UNION ALL SELECT 'p' || k || '.ts:C.run', 'p' || k || '.ts:f' || k, 'calls' FROM f
    UNION ALL SELECT 'p' || k || '.ts:C.go', 'p' || k || '.ts:C.run', 'calls' FROM f""")
def q_link_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, up = F.col("p_partkey").cast("string"), F.expr("p_partkey div 2").cast("string")
    source = F.concat(
        F.lit("import { f"), up, F.lit(" } from './p"), up, F.lit(".js'; // not f0()\nexport function f"), k, F.lit("(a = `f0(${a})`) {\n  return f"), up, F.lit("(/f0()/.test('f0()'));\n}\nclass C {\n  run() { return f"), k, F.lit("(); }\n  go() { this.run(); }\n}\n"),
    )
    files = table(spark, sf_dir, "part").select(F.lit(0).alias("repo_id"), F.concat(F.lit("p"), k, F.lit(".ts")).alias("path"), source.alias("content"))
    parses = files.select("repo_id", "path", extract.parsed(F.col("content"), extract.language_of(F.col("path"))).alias("parse"))
    g = link.link(link.checkpoint(parses), ["repo_id"])
    named = g.symbols.select("gid", F.concat("path", F.lit(":"), "qualified_name").alias("n"))
    out = g.edges.join(named.withColumnsRenamed({"gid": "src", "n": "from"}), "src").join(named.withColumnsRenamed({"gid": "dst", "n": "to"}), "dst")
    return out.select(F.col("from").alias("src"), F.col("to").alias("dst"), "kind")


@query("""
    SELECT conv_id, count(*) FILTER (role = 'user') AS n_add, count(*) FILTER (role = 'assistant') AS n_del, count(*) FILTER (role NOT IN ('user', 'assistant')) AS n_context,
        count(*) FILTER (role <> 'assistant') AS last_new, min(CASE WHEN role = 'user' THEN n END)::BIGINT AS first_added
    FROM (SELECT *, sum(CASE WHEN role <> 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS n FROM conversations) GROUP BY conv_id""")
def q_diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    mark = F.when(F.col("role") == "user", "+").when(F.col("role") == "assistant", "-").otherwise(" ")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text", F.concat(mark, F.regexp_replace("text", r"[\r\n]", " ")).alias("line")))), lambda x: x["line"]), "\n")
    made = turns.groupBy("conv_id").agg(body.alias("b"), F.count_if(F.col("role") != "user").alias("old"), F.count_if(F.col("role") != "assistant").alias("new"))
    head = F.concat(F.lit('diff --git "a/talk '), "conv_id", F.lit('.md" "b/talk '), "conv_id", F.lit('.md"\n--- /dev/null\n+++ "b/talk.md"\n@@ -1,'), "old", F.lit(" +1,"), "new", F.lit(" @@\n"))
    lines = diff.diff_lines(diff.diff_files(made.select("conv_id", F.concat(head, "b").alias("diff")), keys=("conv_id",)), ("conv_id",))
    is_ = lambda t: F.count_if(F.col("type") == t)
    first = F.min(F.when(F.col("type") == "add", F.col("new_line"))).cast("long")
    return lines.groupBy("conv_id").agg(is_("add").alias("n_add"), is_("del").alias("n_del"), is_("context").alias("n_context"), F.coalesce(F.max("new_line"), F.lit(0)).cast("long").alias("last_new"), first.alias("first_added"))


# ---- texts

@query("SELECT doc_id, ceil(length(text) / 3.0)::INT AS tokens FROM documents")
def q_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@query("""
    WITH RECURSIVE p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS seq, ceil(length(text) / 3.0)::INT AS tokens FROM conversations),
    r AS (SELECT conv_id, seq, tokens, tokens <= 200 AS taken, CASE WHEN tokens <= 200 THEN tokens ELSE 0 END AS used FROM p WHERE seq = 1
        UNION ALL SELECT p.conv_id, p.seq, p.tokens, p.tokens <= 200 - r.used, r.used + CASE WHEN p.tokens <= 200 - r.used THEN p.tokens ELSE 0 END FROM r JOIN p ON p.conv_id = r.conv_id AND p.seq = r.seq + 1)
    SELECT conv_id, seq::INT AS seq, tokens, taken FROM r""")
def q_budget_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    pieces = turns.select("conv_id", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).alias("seq"), text.estimate_tokens(F.col("text")).alias("tokens"))
    return context.take_within(pieces, ["conv_id"], "seq", F.lit(200)).select("conv_id", "seq", "tokens", "taken")


_SECRET = "'k = AKIA' || upper(substr(md5(doc_id::VARCHAR), 1, 16)) || ' xoxb-' || md5(doc_id::VARCHAR) || ' https://u:' || substr(md5(doc_id::VARCHAR), 1, 10) || '@h.example/x DB_PASSWORD = \"' || substr(md5(doc_id::VARCHAR), 1, 12) || '\"' || chr(10) || text"
_RE2 = [
    ("aws-access-key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", None),
    ("github-token", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{50,})\b", None),
    ("anthropic-key", r"\bsk-ant-[A-Za-z0-9_-]{20,}", None),
    ("openai-key", r"\bsk-(?:proj-)?[A-Za-z0-9]{32,}\b", None),
    ("slack-token", r"\bxox[abposr]-[A-Za-z0-9-]{10,}", None),
    ("stripe-key", r"\b[rs]k_live_[A-Za-z0-9]{20,}\b", None),
    ("google-api-key", r"\bAIza[0-9A-Za-z_-]{35}\b", None),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", None),
    ("url-credentials", r"""(?i)\b([a-z][a-z0-9+.-]*://[^\s:/@''"]+:)([^\s@/''"]{3,})(@)""", True),
    ("assigned-secret", r"""(?i)(\b[\w.-]*(?:secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth[_-]?token|private[_-]?key|client[_-]?secret)[\w.-]*["'']?\s*[:=]\s*["''`])([^"''`\s]{8,})(["''`])""", True),
]


def _scrub_sql() -> str:
    """The patterns one after the other, each a step of its own with its count."""
    steps = [f"s0 AS (SELECT doc_id, source, {_SECRET} AS t FROM documents)"]
    for i, (name, pattern, grouped) in enumerate(_RE2, 1):
        new = rf"\1[REDACTED:{name}]\3" if grouped else f"[REDACTED:{name}]"
        steps.append(f"s{i} AS (SELECT * EXCLUDE (t), len(regexp_extract_all(t, '{pattern}')) AS n{i}, regexp_replace(t, '{pattern}', '{new}', 'g') AS t FROM s{i - 1})")
    return ", ".join(steps)


def _with_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sum_ = F.md5(F.col("doc_id").cast("string").cast("binary"))
    line = F.concat(F.lit("k = AKIA"), F.upper(F.substring(sum_, 1, 16)), F.lit(" xoxb-"), sum_, F.lit(" https://u:"), F.substring(sum_, 1, 10), F.lit('@h.example/x DB_PASSWORD = "'), F.substring(sum_, 1, 12), F.lit('"\n'), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", "source", line.alias("text"))


@query(f"WITH {_scrub_sql()} SELECT doc_id, sha256(t) AS scrubbed_sha256, {' + '.join(f'n{i}' for i in range(1, 11))} AS n FROM s10")
def q_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = scrub.scrubbed(_with_secrets(spark, sf_dir), "text")
    n = F.aggregate(F.map_values("redactions"), F.lit(0).cast("long"), lambda a, x: a + x)
    return done.select("doc_id", F.sha2("text", 256).alias("scrubbed_sha256"), n.alias("n"))


@query(f"""
    WITH {_scrub_sql()}, k AS (SELECT source, unnest([{', '.join(f"'{n}'" for n, _, _ in _RE2)}]) AS kind, unnest([{', '.join(f'n{i}' for i in range(1, 11))}]) AS n FROM s10)
    SELECT source, kind, sum(n)::BIGINT AS n FROM k GROUP BY ALL HAVING sum(n) > 0""")
def q_redaction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = scrub.scrubbed(_with_secrets(spark, sf_dir), "text").select("source", "redactions")
    return scrub.redaction_totals(done, ["source"]).select("source", F.explode("redactions").alias("kind", "n"))


_DECORATED = "CASE item_id % 3 WHEN 0 THEN '     R8 +  ' || text WHEN 1 THEN '```ts' || chr(10) || ' 7| ' || replace(text, '. ', '.' || chr(10) || '- ') || chr(10) || '```' ELSE '`' || text || '`' END"


@query(rf"""
    WITH d AS (SELECT item_id, trim({_DECORATED}, ' ' || chr(9) || chr(10) || chr(13)) AS e FROM benchmark),
    f AS (SELECT item_id, regexp_replace(regexp_replace(e, '\A```[\w-]*\n?', ''), '\n?```\z', '') AS e FROM d),
    b AS (SELECT item_id, CASE WHEN regexp_matches(e, '\A`[^`]+`\z') THEN substr(e, 2, length(e) - 2) ELSE e END AS e FROM f),
    l AS (SELECT item_id, array_to_string(list_transform(string_split(e, chr(10)), lambda x: regexp_replace(regexp_replace(regexp_replace(x, '^\s*R\d+\s?', ''), '^\s*\d+\|\s?', ''), '^[+-]\s*', '')), chr(10)) AS e FROM b)
    SELECT item_id, trim(regexp_replace(e, '\s+', ' ', 'g')) AS evidence FROM l""")
def q_evidence_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    k, t = F.col("item_id") % 3, F.col("text")
    fenced = F.concat(F.lit("```ts\n 7| "), F.replace(t, F.lit(". "), F.lit(".\n- ")), F.lit("\n```"))
    quoted = F.when(k == 0, F.concat(F.lit("     R8 +  "), t)).when(k == 1, fenced).otherwise(F.concat(F.lit("`"), t, F.lit("`")))
    return items.select("item_id", text.normalize_evidence(quoted).alias("evidence"))


@query("SELECT page_id, sha256(replace(replace(replace(html, '&', '&amp;'), '\"', '&quot;'), '<', '&lt;')) AS escaped_sha256 FROM pages")
def q_render_attr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(text.escape_attribute(F.col("html")), 256).alias("escaped_sha256"))


# ---- comments

@query(f"""
    WITH {_SET_C} SELECT review_id, index::INT AS index, CASE WHEN review_id % 7 = 0 THEN 'file_not_in_diff' WHEN line % 2 = 1 THEN 'line_not_in_diff' WHEN index = 3 THEN 'empty_claim'
        WHEN confidence > 1 OR confidence < 0 THEN 'confidence_out_of_range' WHEN l_suppkey % 3 = 0 AND reverse(claim) <> claim THEN 'evidence_not_found' END AS reason FROM c""")
def q_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _set_c(spark, sf_dir)
    evidence = F.when(F.col("l_suppkey") % 3 == 0, F.reverse("claim")).otherwise(F.col("claim"))
    claim = F.when(F.col("index") == 3, F.lit("  ")).otherwise(F.col("claim"))
    reason = comments.reject_reason(F.col("review_id") % 7 != 0, F.col("line") % 2 == 0, claim, F.col("confidence"), text.normalize_evidence(evidence), text.normalize_code(F.col("claim")))
    return rows.select("review_id", "index", reason.alias("reason"))


@query(f"WITH {_SET_C} SELECT review_id, a::INT AS a, b::INT AS b FROM pairs")
def q_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comments.near_pairs(_set_c(spark, sf_dir), ["review_id"])


@query(f"""
    WITH RECURSIVE {_SET_C},
    both_ways AS (SELECT review_id, a AS index, b AS other FROM pairs UNION ALL SELECT review_id, b, a FROM pairs),
    near AS (SELECT review_id, index, list(other) AS others FROM both_ways GROUP BY ALL),
    o AS (SELECT w.review_id, w.index, coalesce(others, []) AS others, row_number() OVER (PARTITION BY w.review_id ORDER BY rank, confidence DESC, line, w.index) AS r FROM w LEFT JOIN near ON near.review_id = w.review_id AND near.index = w.index),
    f AS (SELECT review_id, r, index, [index] AS kept, 1 AS position, NULL::BIGINT AS duplicate_of FROM o WHERE r = 1
        UNION ALL SELECT o.review_id, o.r, o.index, CASE WHEN len(list_filter(f.kept, lambda k: list_contains(o.others, k))) = 0 THEN list_append(f.kept, o.index) ELSE f.kept END,
        CASE WHEN len(list_filter(f.kept, lambda k: list_contains(o.others, k))) = 0 THEN len(f.kept) + 1 END, list_filter(f.kept, lambda k: list_contains(o.others, k))[1] FROM f JOIN o ON o.review_id = f.review_id AND o.r = f.r + 1)
    SELECT review_id, index::INT AS index, position::INT AS position, duplicate_of::INT AS duplicate_of FROM f""")
def q_greedy_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comments.find_duplicates(_set_c(spark, sf_dir), ["review_id"])


_RANKED = """
    c AS (SELECT o_custkey, o_orderkey, o_orderstatus = 'P' AS bad, least(substr(o_orderpriority, 1, 1)::INT, 4) AS severity, floor(o_totalprice)::BIGINT % 10 AS sure, ['apple', 'Banana', 'cherry', 'Date'][o_orderkey % 4 + 1] AS name FROM orders),
    r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY severity, sure DESC, lower(name), o_orderkey) AS rank FROM c WHERE NOT bad),
    s AS (SELECT o_custkey, o_orderkey, rank, CASE WHEN bad THEN 'invalid' WHEN rank <= 3 THEN 'selected' ELSE 'over_cap' END AS status FROM c LEFT JOIN r USING (o_custkey, o_orderkey))"""


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as comments on lines far apart, some of them invalid; of equals the file decides, as people sort names."""
    o = table(spark, sf_dir, "orders")
    severity = F.element_at(F.array(*[F.lit(s) for s in comments.SEVERITIES]), F.least(F.substring("o_orderpriority", 1, 1).cast("int"), F.lit(4)))
    name = F.element_at(F.array(*[F.lit(f"src/{n}.ts") for n in ("apple", "Banana", "cherry", "Date")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    found = o.select(
        "o_custkey", F.col("o_orderkey").cast("int").alias("index"), name.alias("file"), (F.col("o_orderkey") * 10).cast("int").alias("line"), F.lit("bug").alias("category"), severity.alias("severity"), F.lit("claim").alias("claim"),
        F.lit("x").alias("evidence"), F.lit(None).cast("string").alias("suggested_fix"), (F.floor("o_totalprice") % 10 / 10).cast("double").alias("confidence"), F.when(F.col("o_orderstatus") == "P", "line_not_in_diff").alias("reject_reason"),
    )
    return comments.decide(found, F.lit(3), ["o_custkey"])


@query(f"WITH {_RANKED} SELECT o_custkey, o_orderkey, rank::INT AS rank, status FROM s")
def q_rank_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select("o_custkey", F.col("index").cast("long").alias("o_orderkey"), "rank", "status")


@query(f"WITH {_RANKED} SELECT o_custkey, status, count(*) AS n FROM s GROUP BY ALL")
def q_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comments.status_counts(_decided(spark, sf_dir), ["o_custkey"])


@query(f"WITH {_RANKED} SELECT o_custkey, o_orderkey, (rank - 1)::INT AS seq FROM s WHERE status = 'selected'")
def q_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comments.selected(_decided(spark, sf_dir), ["o_custkey"]).select("o_custkey", F.col("index").cast("long").alias("o_orderkey"), "seq")


# ---- calls, storage, jobs

_MODEL = "CASE event_type WHEN 'signup' THEN 'claude-opus-5-5' WHEN 'error' THEN 'claude-fable-5-1' WHEN 'click' THEN 'claude-haiku-4-5' WHEN 'view' THEN 'fake' ELSE 'unlisted' END"


@query(f"""
    WITH p(model, input, output, cr, cw) AS (VALUES ('claude-fable-5-1', 10.0::DOUBLE, 50.0::DOUBLE, 0.25::DOUBLE, 12.5::DOUBLE), ('claude-opus-5-5', 4, 20, 0.2, 5), ('claude-haiku-4-5', 1, 5, 0.1, 1.25), ('fake', 0, 0, 0, 0)),
    u AS (SELECT event_id, {_MODEL} AS served_model, 1000 * (event_id % 90) AS i, 1000 * (user_id % 7) AS o, 20000 * (event_id % 3) AS r, 4000 * (user_id % 2) AS w FROM events)
    SELECT event_id, served_model, round((i * input + o * output + r * cr + w * cw) / 1000000, 6)::DECIMAL(12,6) AS cost_usd FROM u LEFT JOIN p ON model = served_model""")
def q_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    use = table(spark, sf_dir, "events").select(
        "event_id", F.expr(_MODEL).alias("served_model"), (F.col("event_id") % 90 * 1000).alias("input_tokens"), (F.col("user_id") % 7 * 1000).alias("output_tokens"), (F.col("event_id") % 3 * 20_000).alias("cache_read_tokens"), (F.col("user_id") % 2 * 4_000).alias("cache_write_tokens")
    )
    return model_calls.with_cost(use).select("event_id", "served_model", "cost_usd")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def q_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("""
    WITH l AS (SELECT o_custkey AS k, o_orderpriority AS title, md5(o_orderkey::VARCHAR) AS sha FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
    SELECT coalesce(c_custkey, k) AS number, CASE WHEN l.k IS NULL THEN c_name ELSE title END AS title, CASE WHEN l.k IS NULL THEN 'old' ELSE sha END AS head_sha, CASE WHEN c_custkey IS NULL THEN NULL ELSE c_mktsegment END AS status
    FROM (SELECT * FROM customer WHERE c_nationkey % 2 = 0) c FULL JOIN l ON k = c_custkey""")
def q_upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "customer").filter("c_nationkey % 2 = 0").select(F.col("c_custkey").alias("number"), F.col("c_name").alias("title"), F.lit("old").alias("head_sha"), F.col("c_mktsegment").alias("status"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("number"), F.col("o_orderpriority").alias("title"), F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("head_sha"), "o_orderdate", "o_orderkey")
    return store.upsert(stored, rows, ["number"], ["title", "head_sha"], ["o_orderdate", "o_orderkey"])


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 AND o_orderstatus = 'F' THEN 'already_posted' WHEN o_orderkey % 2 = 1 THEN 'reset' ELSE 'new' END AS decision FROM orders""")
def q_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    key = [F.col("o_custkey").alias("pr_id"), F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("head_sha"), F.lit("c").alias("config_hash")]
    blank = store.empty(spark, "reviews")
    had = orders.filter("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("id"), *key, F.when(F.col("o_orderstatus") == "F", "posted").otherwise("failed").alias("status"))
    reviews = blank.unionByName(had, allowMissingColumns=True)
    wanted = orders.select(*key, F.lit("S1").alias("strategy"), F.lit("{}").alias("strategy_config_json"), F.lit("m").alias("model"), F.lit("review/v1").alias("prompt_version"), F.col("o_orderdate").cast("timestamp_ntz").alias("started_at"))
    done = store.claim_reviews(reviews, store.empty(spark, "candidate_comments"), wanted).decided
    return orders.select("o_orderkey", *key).join(done, ["pr_id", "head_sha", "config_hash"]).select("o_orderkey", "decision")


@query("SELECT DISTINCT 'pr-' || user_id || '-' || (event_id % 50) || '-' || sha1(user_id::VARCHAR) AS job_id FROM events WHERE event_type IN ('signup', 'click')")
def q_job_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").filter(F.col("event_type").isin("signup", "click"))
    jobs = events.select(ids.review_job_id(F.col("user_id"), F.col("event_id") % 50, F.sha1(F.col("user_id").cast("string").cast("binary"))).alias("job_id"), "ts")
    return ingest.once(jobs).select("job_id")


@query("""
    WITH h AS (SELECT user_id, event_id AS last, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
    SELECT event_id, CASE WHEN event_id <> last THEN 'superseded' WHEN h.event_type = 'error' THEN 'closed' ELSE 'run' END AS decision FROM events JOIN h USING (user_id)""")
def q_superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", F.col("user_id").alias("repository_id"), F.lit(1).alias("pull_number"), F.col("event_id").cast("string").alias("head_sha"))
    heads = ingest.latest_heads(jobs, ["ts", "event_id"])
    states = jobs.groupBy("repository_id", "pull_number").agg(F.max_by(F.when(F.col("event_type") == "error", "closed").otherwise("open"), F.struct("ts", "event_id")).alias("state"))
    return ingest.current(jobs, heads.join(states, ["repository_id", "pull_number"])).select("event_id", "decision")


@query("""
    WITH d AS (SELECT doc_id, source, sha1(text) AS b, doc_id % 2 = 0 AS had, doc_id % 3 <> 0 AS has, doc_id % 5 = 0 AS changed FROM documents),
    a AS (SELECT source, CASE WHEN had AND NOT has THEN 'delete' WHEN had AND changed THEN 'rewrite' WHEN had THEN 'keep' ELSE 'write' END AS action FROM d WHERE had OR has)
    SELECT source AS repo_id, action, count(*) AS n FROM a GROUP BY ALL""")
def q_incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("repo_id"), F.concat(F.lit("d"), "doc_id", F.lit(".ts")).alias("path"), F.sha1("text").alias("blob_hash"))
    old = docs.filter("doc_id % 2 = 0").withColumn("blob_hash", F.when(F.col("doc_id") % 5 == 0, F.lit("before")).otherwise(F.col("blob_hash")))
    stored = old.select(F.col("doc_id").alias("id"), "repo_id", "path", F.lit("typescript").alias("language"), "blob_hash", F.lit(ids.PARSER_VERSION).alias("parser_version"))
    now = docs.filter("doc_id % 3 <> 0").select("repo_id", "path", F.lit("typescript").alias("language"), "blob_hash")
    return store.compare_files(stored, now).groupBy("repo_id", "action").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT s_suppkey, substr(sha256('{"active":null,"name":"' || s_name || '","nation":' || s_nationkey || ',"suppkey":' || s_suppkey || '}'), 1, 16) AS config_hash FROM supplier""")
def q_config_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"suppkey": F.col("s_suppkey"), "name": F.col("s_name"), "nation": F.col("s_nationkey"), "active": F.lit(None).cast("string")}
    return table(spark, sf_dir, "supplier").select("s_suppkey", ids.hash_column(ids.stable_json_column(fields)).alias("config_hash"))


@query(f"""
    SELECT l_orderkey AS review_id, ({_C})::INT AS index, greatest(CASE WHEN l_returnflag = 'R' THEN 7000 ELSE 0 END, floor(l_discount * 5 * least(30000.0::DOUBLE, 1000.0::DOUBLE * pow(2.0::DOUBLE, l_linenumber - 1)))::BIGINT) AS wait_ms FROM lineitem""")
def q_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    index = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")) - 1
    asked = F.when(F.col("l_returnflag") == "R", 7000)
    return items.select(F.col("l_orderkey").alias("review_id"), index.alias("index"), timing.backoff_ms(F.col("l_linenumber"), F.col("l_discount") * 5, asked).alias("wait_ms"))


@query("""
    WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events)
    SELECT event_id, CASE WHEN n < 3 THEN 'key#' || (n + 1) ELSE 'key#' || ((n - 3) % 2 * 2 + 1) END AS label FROM e""")
def q_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events ask one pool of three keys in turn; the second is rejected at its first use."""
    import math

    import pandas as pd

    def asked(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, pool, labels = pdf.sort_values(["ts", "event_id"]), model_calls.KeyPool("abc", now=lambda: 0.0), []
        for _ in range(len(pdf)):
            key = pool.take()
            labels.append(key.label)
            if key.label == "key#2":
                pool.hold(key, math.inf, "rejected")
        return pdf.assign(label=labels)[["event_id", "label"]]

    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return events.groupBy("user_id").applyInPandas(asked, "event_id long, label string")


@query("""
    SELECT event_type, CASE WHEN user_id % 4 = 3 THEN 'invalid signature' WHEN event_type = 'signup' THEN 'pong' WHEN event_type = 'click' THEN 'queued' WHEN event_type = 'view' THEN 'ignored'
        WHEN event_type = 'purchase' THEN CASE user_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'ignored' ELSE 'malformed push payload' END ELSE 'invalid JSON' END AS outcome, count(*) AS n FROM events GROUP BY ALL""")
def q_webhook_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as webhooks: some pull requests, some pushes, some broken, a quarter signed with another secret."""
    import pandas as pd

    kind, who = F.col("event_type"), F.col("user_id")
    name = F.when(kind == "signup", "ping").when(kind.isin("click", "view"), "pull_request").otherwise("push")
    place = F.struct(F.struct(who.alias("id")).alias("installation"), F.struct(who.alias("id"), F.lit("r").alias("name"), F.lit("main").alias("default_branch"), F.struct(F.lit("o").alias("login")).alias("owner")).alias("repository"))
    sha = F.sha1(F.col("event_id").cast("string").cast("binary"))
    pull = F.to_json(F.struct(F.when(kind == "click", "opened").otherwise("closed").alias("action"), F.struct((F.col("event_id") % 1000).alias("number"), F.struct(sha.alias("sha")).alias("head"), F.struct(sha.alias("sha")).alias("base")).alias("pull_request"), place["installation"].alias("installation"), place["repository"].alias("repository")))
    ref = F.when(who % 4 == 0, "refs/heads/main").when(who % 4 == 1, "refs/heads/side")
    push = F.to_json(F.struct(ref.alias("ref"), sha.alias("after"), F.lit(False).alias("deleted"), place["installation"].alias("installation"), place["repository"].alias("repository")))
    body = F.when(kind == "signup", "{}").when(kind.isin("click", "view"), pull).when(kind == "purchase", push).otherwise('{"broken')

    def signed(bodies: pd.Series, users: pd.Series) -> pd.Series:
        return pd.Series([timing.sign("other" if u % 4 == 3 else "secret", b.encode()) for b, u in zip(bodies, users, strict=True)], dtype="object")

    signed.__annotations__ = {"bodies": pd.Series, "users": pd.Series, "return": pd.Series}
    raw = table(spark, sf_dir, "events").select("event_type", name.alias("event"), F.col("event_id").cast("string").alias("delivery_id"), body.alias("b"), who.alias("u"))
    raw = raw.select("event_type", "event", "delivery_id", F.pandas_udf(signed, "string")("b", "u").alias("signature"), F.encode("b", "UTF-8").alias("raw_body"))
    return ingest.routed(raw, "secret").groupBy("event_type", "outcome").agg(F.count(F.lit(1)).alias("n"))


# ---- whole indexes

_REPOS = """
    o AS (SELECT o_custkey % 100 AS repo_id, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey % 100 ORDER BY o_orderkey) AS next FROM orders),
    i AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey),
    f AS (SELECT repo_id, o_orderkey, next, coalesce(n, 0) AS n FROM o LEFT JOIN i ON l_orderkey = o_orderkey)"""


def _sources(spark: SparkSession, sf_dir: str, repositories: int = 100, only: int | None = None) -> DataFrame:
    """A source file per order, a hundred repositories: a function that calls one helper per line item and the next file."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    own = orders.select((F.col("o_custkey") % repositories).alias("repo_id"), F.col("o_orderkey").alias("k"))
    own = own if only is None else own.filter(F.col("repo_id") == only)
    own = own.withColumn("next", F.coalesce(F.lead("k").over(W.partitionBy("repo_id").orderBy("k")), F.lit(-1)))
    counts = items.groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    files = own.join(counts, "k", "left").fillna(0, ["n"])
    each = F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n"))).otherwise(F.array().cast("array<int>"))
    calls = F.array_join(F.transform(each, lambda i: F.concat(F.lit("  total += item"), i, F.lit("(n, `#${n}`); // item0()\n"))), "")
    helpers = F.array_join(F.transform(each, lambda i: F.concat(F.lit("\nconst item"), i, F.lit(" = (n: number, label?: string): number => {\n  return n * "), i, F.lit(";\n};\n"))), "")
    content = F.concat(F.lit("import { run as next } from './o"), F.col("next"), F.lit(".js'; // from "), F.col("k"), F.lit("\n\nexport function run(n: number): number {\n  let total = next(n - 1);\n"), calls, F.lit("  return total;\n}\n"), helpers)
    path = F.concat(F.lit("src/o"), F.col("k"), F.lit(".ts"))
    return files.select("repo_id", F.lit("head").alias("sha"), path.alias("path"), ids.blob_sha(content).alias("blob_sha"), F.octet_length(content).cast("long").alias("size"), content.alias("content"))


@query(f"""
    WITH {_REPOS} SELECT repo_id, count(*) AS files, sum(n + 2)::BIGINT AS symbols, sum(n + 1)::BIGINT AS calls_total, (sum(n) + count(next))::BIGINT AS calls_resolved,
        count(*) AS imports_total, count(next) AS imports_resolved, count(*) - count(next) AS imports_external, (sum(n) + count(next))::BIGINT AS edges_calls, count(next) AS edges_imports FROM f GROUP BY repo_id""")
def q_index_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import review

    run = review.index_files(_sources(spark, sf_dir))
    g = link.link(run.parses.select(*review.GRAPH, "path", "parse"), review.GRAPH)
    return g.stats.select("repo_id", "files", "symbols", "calls_total", "calls_resolved", "imports_total", "imports_resolved", "imports_external", "edges_calls", "edges_imports")


@query(f"WITH {_REPOS} SELECT repo_id, count(*) AS files_listed, count(*) AS files_indexed, count(*) FILTER (o_orderkey % 10 = 0) AS parsed, count(*) FILTER (o_orderkey % 10 <> 0) AS from_cache, 0::BIGINT AS unreadable FROM f GROUP BY repo_id")
def q_index_warm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files against a cache that has nine in ten of them."""
    from . import review

    files = _sources(spark, sf_dir)
    key = ids.parse_cache_key(F.lit("typescript"), F.col("blob_sha"))
    known = files.filter("cast(regexp_extract(path, '[0-9]+', 0) as long) % 10 <> 0").select(key.alias("key"), _parse(f"array({_MODULE})").alias("parse"))
    return review.index_files(files, known).stats.drop("sha")


@query(f"""
    WITH {_REPOS} SELECT count(*) AS files, sum(n + 2)::BIGINT AS symbols, (sum(n) + count(next))::BIGINT AS edges_calls, count(next) AS edges_imports
    FROM (SELECT o_orderkey, lead(o_orderkey) OVER (ORDER BY o_orderkey) AS next, coalesce(n, 0) AS n FROM orders LEFT JOIN i ON l_orderkey = o_orderkey WHERE o_custkey % 1000 = 7)""")
def q_index_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One repository by itself, of about 150 files at a tenth of the scale."""
    from . import review

    run = review.index_files(_sources(spark, sf_dir, 1000, 7))
    g = link.link(run.parses.select(*review.GRAPH, "path", "parse"), review.GRAPH)
    return g.stats.select("files", "symbols", "edges_calls", "edges_imports")

