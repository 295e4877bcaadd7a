from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from codeloom.operators import context, diff, graph, link, ranges
from codeloom.operators.context import choose_views
from codeloom.plans import review
from codeloom.sources import trees

from .samples import FILES

KEYS, GRAPH = review.KEYS, review.GRAPH


def linked(spark, contents):
    files = trees.memory(spark, contents).withColumn("repo_id", F.lit(1)).withColumn("sha", F.lit("h"))
    run = review.index_files(files)
    return link.link(link.checkpoint(run.parses.select(*GRAPH, "path", "parse")), GRAPH), run


@pytest.fixture(scope="module")
def sample(spark):
    return linked(spark, FILES)


def edges(g):
    name = {r["gid"]: f"{r['path']}:{r['qualified_name']}" for r in g.symbols.collect()}
    out = {}
    for e in g.edges.orderBy("seq").collect():
        out.setdefault(name[e["src"]], []).append(f"{e['kind']} {name[e['dst']]}")
    return {k: sorted(v) for k, v in out.items()}


def test_edges(sample):
    assert edges(sample[0]) == {
        "app/clock.ts:Span.of": ["calls app/clock.ts:Span", "calls app/clock.ts:minutes"],
        "app/clock.ts:Span.overlaps": ["calls app/clock.ts:Span.empty"],  # not other.contains: other may be anything
        "app/vessel.ts:<module>": ["imports app/clock.ts:Span"],
        "app/vessel.ts:Vessel.moor": ["calls app/vessel.ts:Vessel.capacity", "calls app/vessel.ts:Vessel.note"],
        "app/ferries/ferry.ts:<module>": ["imports app/clock.ts:<module>", "imports app/vessel.ts:Timetabled", "imports app/vessel.ts:Vessel"],
        "app/ferries/ferry.ts:Ferry": ["extends app/vessel.ts:Vessel", "implements app/vessel.ts:Timetabled"],
        "app/ferries/ferry.ts:Ferry.capacity": ["calls app/ferries/ferry.ts:seatsPer"],
        "app/ferries/ferry.ts:Ferry.depart": ["calls app/clock.ts:minutes", "calls app/vessel.ts:Vessel.moor"],  # of a namespace, and inherited
        "ui/board.tsx:<module>": ["imports app/clock.ts:minutes", "imports app/ferries/ferry.ts:Ferry"],  # through the re-exports between
        "ui/board.tsx:Board": ["calls app/clock.ts:minutes", "calls app/ferries/ferry.ts:Ferry", "calls ui/board.tsx:Row"],
        "tools/load.cjs:<module>": ["calls tools/load.cjs:load", "imports app/clock.ts:Span", "imports app/clock.ts:minutes"],
        "tools/load.cjs:load": ["calls app/clock.ts:minutes", "calls tools/load.cjs:read"],
        "tools/load.cjs:main": ["calls tools/load.cjs:load"],
    }


def test_stats_and_index(sample):
    g, run = sample
    s = g.stats.first()
    assert (s["files"], s["imports_total"], s["imports_external"], s["imports_internal"]) == (6, 11, 2, 9)
    assert s["imports_resolved"] == 8  # no module has a Tide
    i = run.stats.first()
    assert (i["files_listed"], i["files_indexed"], i["parsed"], i["from_cache"], i["unreadable"]) == (8, 6, 6, 0, 0)


def test_incremental_index(spark, sample):
    cache = sample[1].new_parses
    changed = FILES | {"app/vessel.ts": FILES["app/vessel.ts"] + "export const knots = 1.852;\n", "big.ts": "x" * 600_000}
    files = trees.memory(spark, changed).withColumn("repo_id", F.lit(1)).withColumn("sha", F.lit("h2")).withColumn("size", F.lit(None).cast("long"))
    run = review.index_files(files, cache)
    i = run.stats.first()
    assert (i["parsed"], i["from_cache"], i["unreadable"]) == (1, 5, 1) and run.new_parses.count() == 1


def test_resolution_order_and_odd_specifiers(spark):
    files = spark.createDataFrame([(p,) for p in ("a/x.ts", "a/x.tsx", "a/y/index.js", "b.ts", "a/z.js", "a/z.js.ts", "index.ts")], "path string")
    asks = ["./x", "./x.js", "./x.jsx", "./y", "./y/", "../b", "./../a/./x", "../../b", "./z.js", "./none", "x", "..", "."]
    wanted = spark.createDataFrame([("a/m.ts", s) for s in asks], "path string, source string")
    got = {r["source"]: r["target"] for r in link.resolve_modules(wanted, files, []).collect()}
    assert got == {"./x": "a/x.ts", "./x.js": "a/x.ts", "./x.jsx": "a/x.tsx", "./y": "a/y/index.js", "../b": "b.ts", "./../a/./x": "a/x.ts", "./z.js": "a/z.js"}


def test_re_exports(spark):
    contents = {
        "d.ts": "export const v = 1; export const w = 2; export default function () {}\n",
        "c.ts": "export * from './d'; export const w = 3;\n",
        "b.ts": "export { v as u } from './c'; export * from './c'; export { gone } from './c'; export { default as dd } from './d';\n",
        "e.ts": "export { gone } from './c';\nexport * from './f';\n",
        "f.ts": "export const gone = 1;\n",
        "x.ts": "export * from './y'; export const only = 1;\n",
        "y.ts": "export * from './x'; export * from './d';\n",
        "a.ts": "import { u, v, w, dd, only } from './b'; import { gone } from './e'; import { only as o, v as p } from './y'; import { v as q } from './x';\n",
    }
    g, _ = linked(spark, contents)
    name = {r["gid"]: f"{r['path']}:{r['name']}" for r in g.symbols.collect()}
    assert edges(g)["a.ts:<module>"] == ["imports c.ts:w", "imports d.ts:default", "imports d.ts:v", "imports x.ts:only"] and name
    # u, v, p and q are one symbol; `only` is not in b; a named re-export that leads nowhere hides the star after it


def test_long_re_export_chain_ends(spark):
    contents = {f"m{i}.ts": f"export * from './m{i + 1}';\n" for i in range(12)} | {"m12.ts": "export const deep = 1;\n", "near.ts": "import { deep } from './m4';\n", "far.ts": "import { deep } from './m3';\n"}
    got = edges(linked(spark, contents)[0])
    assert got["near.ts:<module>"] == ["imports m12.ts:deep"] and "far.ts:<module>" not in got


def test_one_inherited_level(spark):
    contents = {"k.ts": "class A { a() {} }\nclass B extends A { b() { this.a(); } }\nclass C extends B { c() { this.a(); this.b(); const f = () => this.c(); } static s() {} }\nC.s(); C.b(); C.a();\n"}
    got = edges(linked(spark, contents)[0])
    assert got["k.ts:B.b"] == ["calls k.ts:A.a"] and got["k.ts:C.c"] == ["calls k.ts:B.b"]
    assert got["k.ts:<module>"] == ["calls k.ts:B.b", "calls k.ts:C.s"]
    assert got["k.ts:C.c.f"] == ["calls k.ts:C.c"]


CHANGE = """diff --git a/app/ferries/ferry.ts b/app/ferries/ferry.ts
--- a/app/ferries/ferry.ts
+++ b/app/ferries/ferry.ts
@@ -9,4 +9,3 @@
   slots: clock.Span[] = [];
-  // ships that sail
   static fleet = 0;
   constructor(readonly name: string, private decks: Deck[]) { super(); }
@@ -17,5 +16,5 @@

   depart = async (pier: string) => {
     this.moor(pier);
-    await axios.post('/departures', { at: 0 });
+    await axios.post('/departures', { at: clock.minutes('10:00') });
   };
diff --git a/tools/load.cjs b/tools/load.cjs
--- a/tools/load.cjs
+++ b/tools/load.cjs
@@ -9,2 +9,3 @@

+module.exports = { load, slot: Slot };
 exports.main = () => load(process.argv[2]);
"""


def changed_of(spark, g, text, review_id=7):
    changes = spark.createDataFrame([(1, "h", review_id, text)], "repo_id int, sha string, review_id int, diff string")
    lines = diff.diff_lines(diff.diff_files(changes, keys=tuple(KEYS)), tuple(KEYS))
    return ranges.changed_symbols(lines, g.symbols, KEYS, GRAPH)


def test_changed_symbols(spark, sample):
    got = {(r["path"], r["qualified_name"]): list(r["lines"]) for r in changed_of(spark, sample[0], CHANGE).collect()}
    # a removed line counts for the line before it; a line between functions is the module's
    assert got == {("app/ferries/ferry.ts", "Ferry"): [9], ("app/ferries/ferry.ts", "Ferry.depart"): [19], ("tools/load.cjs", "<module>"): [10]}


def test_deletion_at_the_ends_of_a_file(spark):
    contents = {"t.ts": "function a() {\n}\nfunction b() {\n}"}
    g, _ = linked(spark, contents)
    text = "diff --git a/t.ts b/t.ts\n--- a/t.ts\n+++ b/t.ts\n@@ -1,2 +1,1 @@\n-gone\n function a() {\n@@ -4,2 +3,1 @@\n function b() {\n-gone\n"
    assert {r["qualified_name"]: list(r["lines"]) for r in changed_of(spark, g, text).collect()} == {"a": [1], "b": [3]}


def test_innermost_prefers_short_then_late(spark):
    spans = spark.createDataFrame([(0, 0, 1, 500), (0, 1, 10, 20), (0, 2, 12, 14), (0, 3, 12, 14), (0, 4, 300, 200)], "f int, id int, start_line int, end_line int")
    lines = spark.createDataFrame([(0, n) for n in (1, 9, 10, 13, 15, 20, 21, 250, 500, 501)], "f int, line int")
    got = {r["line"]: r["id"] for r in ranges.innermost(lines, spans, ["f"]).collect()}
    assert got == {1: 0, 9: 0, 10: 1, 13: 3, 15: 1, 20: 1, 21: 0, 250: 0, 500: 0, 501: None}


def seed(g, path, name, lines):
    row = g.symbols.filter((F.col("path") == path) & (F.col("qualified_name") == name))
    return row.select(*GRAPH, F.lit(7).alias("review_id"), "gid", "path", "qualified_name", "kind", F.array(*[F.lit(x) for x in lines]).alias("lines"))


def ranked(g, changed, out, back):
    return graph.rank_candidates(changed, g.symbols, g.edges, g.call_sites, out, back, KEYS, GRAPH)


def test_candidates(sample):
    g = sample[0]
    near = ranked(g, seed(g, "app/clock.ts", "Span.of", [13]), 1, 0).orderBy("seq").collect()
    assert [(r["distance"], r["role"], r["qualified_name"], r["relation"]) for r in near] == [(0, "enclosing", "Span.of", "changed in this diff"), (1, "callee", "minutes", "called by Span.of"), (1, "callee", "Span", "called by Span.of")]
    far = ranked(g, seed(g, "app/clock.ts", "minutes", [5]), 2, 2).orderBy("seq").collect()
    assert [(r["distance"], r["role"], r["qualified_name"]) for r in far][0] == (0, "enclosing", "minutes")
    assert {(r["distance"], r["path"], r["qualified_name"]) for r in far if r["role"] == "caller"} == {
        (1, "app/clock.ts", "Span.of"), (1, "app/ferries/ferry.ts", "Ferry.depart"), (1, "tools/load.cjs", "load"), (1, "ui/board.tsx", "Board"), (2, "tools/load.cjs", "main"),
    } and [r["distance"] for r in far] == sorted(r["distance"] for r in far)


def test_fan_in_and_base(sample):
    g = sample[0]
    two = seed(g, "app/ferries/ferry.ts", "Ferry", [9]).unionByName(seed(g, "app/ferries/ferry.ts", "Ferry.depart", [18]))
    got = {r["qualified_name"]: (r["role"], r["fan_in"], r["related_to"]) for r in ranked(g, two, 2, 0).collect()}
    assert got["Vessel"] == ("base", 1, "Ferry") and got["Vessel.moor"] == ("callee", 1, "Ferry.depart") and got["minutes"][0] == "callee"


def test_changed_module_follows_calls_on_its_lines(spark):
    g, _ = linked(spark, {"src/l.ts": "export function a() { c(); }\nexport function b() {}\nfunction c() {}\n", "t/l.test.ts": "import { a, b } from '../src/l';\nit('one', () => { a(); });\nit('two', () => { b(); });\n"})
    got = [(r["role"], r["distance"], r["qualified_name"]) for r in ranked(g, seed(g, "t/l.test.ts", "<module>", [2]), 2, 0).orderBy("seq").collect()]
    assert got == [("callee", 1, "a"), ("callee", 2, "c")]


def test_walk_reaches_each_node_once(spark):
    rows = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (4, 5), (5, 6)]
    e = spark.createDataFrame([(a, b, "calls", i) for i, (a, b) in enumerate(rows)], "src int, dst int, kind string, seq int")
    starts = spark.createDataFrame([("s", 1, 0)], "k string, node int, pos long")
    got = {(r["node"], r["distance"]) for r in graph.walk(starts, e, 3, ["k"], []).collect()}
    assert got == {(2, 1), (3, 1), (4, 2), (5, 3)}
    assert graph.walk(starts, e, 0, ["k"], []).count() == 0
    back = {(r["node"], r["distance"]) for r in graph.walk(starts, e, 2, ["k"], [], outward=False).collect()}
    assert back == {(4, 1), (2, 2), (3, 2)}


def assembled(spark, g, contents, changed, budget, most=2000, out=1, back=0):
    heads = spark.createDataFrame([(1, "h", 7, p, c) for p, c in contents.items()], "repo_id int, sha string, review_id int, path string, content string")
    limits = spark.createDataFrame([(1, "h", 7, budget, most)], "repo_id int, sha string, review_id int, remaining int, max_symbol_tokens int")
    return context.assemble(context.symbol_views(ranked(g, changed, out, back), heads, KEYS), limits, KEYS)


def test_sections_shrink_with_the_budget(spark, sample):
    g = sample[0]
    changed = seed(g, "tools/load.cjs", "load", [7])
    roomy = assembled(spark, g, FILES, changed, 10_000).orderBy("seq").collect()
    assert [(r["qualified_name"], r["mode"]) for r in roomy] == [("load", "full"), ("minutes", "full"), ("read", "full")]
    assert "7|   return read(path).split('\\n').map((l) => minutes(l));" in roomy[0]["text"] and 'relation="called by load"' in roomy[1]["text"]
    tight = assembled(spark, g, FILES, changed, roomy[0]["tokens"] + 60)
    modes = [r["mode"] for r in tight.orderBy("seq").collect()]
    assert modes[0] == "full" and modes[1] == "signature"
    s = context.assembly_stats(tight, KEYS).first()
    assert (s["included"], s["signature_only"], s["omitted"]) == (3 - modes.count(None), modes.count("signature"), modes.count(None)) and s["tokens"] <= roomy[0]["tokens"] + 60


def test_contained_symbols_are_passed_by(spark, sample):
    g = sample[0]
    changed = seed(g, "app/clock.ts", "Span", [10]).unionByName(seed(g, "app/clock.ts", "Span.of", [13]))
    got = assembled(spark, g, FILES, changed, 10_000).orderBy("seq").collect()
    assert [r["qualified_name"] for r in got if r["mode"]] == ["Span", "minutes"]


def test_excerpt(spark):
    contents = {"big.ts": "export function big() {\n" + "\n".join(f"  const v{i} = {i};" for i in range(80)) + "\n}\n"}
    g, _ = linked(spark, contents)
    (row,) = assembled(spark, g, contents, seed(g, "big.ts", "big", [41]), 10_000, most=300).collect()
    assert (row["mode"], row["start_line"], row["end_line"]) == ("excerpt", 26, 56)
    assert " 1| function big() …\n  | …\n26|" in row["text"] and "41|   const v39 = 39;" in row["text"] and row["text"].endswith("\n  | …\n</symbol>")


def test_choose_views_by_hand():
    row = lambda seq, full, excerpt=None, signature=5, path="a", lines=(1, 9): {"seq": seq, "path": path, "start_line": lines[0], "end_line": lines[1], "full_tokens": full, "excerpt_tokens": excerpt, "signature_tokens": signature}
    rows = [row(0, 50, 20), row(1, 10, lines=(20, 30)), row(2, 3, lines=(21, 22)), row(3, 100, None, 9, "b"), row(4, 4, path="b", lines=(50, 60)), row(5, None, None, None, "c")]
    assert choose_views(rows, 40, 30) == [(0, "excerpt"), (1, "full"), (3, "signature"), (4, None), (5, None)]


def test_report(spark, sample):
    import json

    g, run = sample
    said = json.loads(review.report(run, g).first()["report"])
    assert said["files_indexed"] == 6 and said["symbol_kinds"]["class"] == 3 and said["most_called"][0] == "app/clock.ts:minutes (4 callers)"


def test_modules_by_the_bases_of_files(spark):
    """A file tells each base that an import may find it by, in the order that an import tries, and few of them."""
    swaps = [(old, new) for old, news in link.STANDS_FOR.items() for new in news]
    tried = [*link.TRIED, *[f"/index{e}" for e in link.TRIED]]

    def forward(base):
        swapped = [base[: -len(old)] + new for old, new in swaps if base.endswith(old) and base[: -len(old)] not in ("",) and base[-len(old) - 1] != "/"]
        return [base, *swapped, *[base + t for t in tried]]

    paths = ["a/b.ts", "a/b.tsx", "a/b.js", "a/b.mts", "a/b/index.ts", "a/b/index.js", "a/.ts", ".ts", "index.ts", "./index.ts", "a/b.d.ts", "a/b.json", "a/b"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select("path", F.inline(link.reached_from(F.col("path")))).collect()
    assert max(sum(r["path"] == p for r in rows) for p in paths) <= 5
    for base in ["a/b", "a/b.js", "a/b.jsx", "a/b.mjs", "a/", "a/.js", ".js", ".", "a/b.ts", "a/b/index", "a/b.d.js", "a/b.d"]:
        assert [r["path"] for r in sorted((r for r in rows if r["base"] == base), key=lambda r: r["rank"])] == [p for p in forward(base) if p in paths], base
