from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from codeloom.operators import extract, lexer
from codeloom.operators.extract import language_of, parse_source, parsed

from .samples import FILES


def symbols(text, language="typescript"):
    return [(s["qualified_name"], s["kind"]) for s in parse_source(text, language)["symbols"][1:]]


def calls(text, language="typescript"):
    return [(c["kind"], c["callee"], c["from"]) for c in parse_source(text, language)["calls"]]


def spans(text, language="typescript"):
    return {s["qualified_name"]: (s["kind"], s["start_line"], s["end_line"], s["exported"], s["signature"]) for s in parse_source(text, language)["symbols"]}


def test_a_module_of_functions_and_a_class():
    got = spans(FILES["app/clock.ts"])
    assert got["<module>"] == ("module", 1, 23, False, "") and got["minutes"] == ("function", 4, 7, True, "function minutes(time: string): number")
    assert got["Span"] == ("class", 9, 22, True, "class Span") and got["PER_HOUR"][:4] == ("variable", 1, 1, False)
    assert {k: v[4] for k, v in got.items() if v[0] == "method"} == {
        "Span.constructor": "constructor(public from: number, public to: number)", "Span.length": "get length()", "Span.of": "static of(a: string, b: string)",
        "Span.overlaps": "overlaps(other: Span): boolean", "Span.contains": "contains(t: number): boolean", "Span.empty": "private empty()",
    }
    p = parse_source(FILES["app/clock.ts"], "typescript")
    assert [p["symbols"][s["parent"]]["name"] for s in p["symbols"][4:]] == ["Span"] * 6
    # what is called on a parameter is known by its name; the call on a call's result can't be told
    called = [(p["symbols"][c["from"]]["name"], c["kind"], c["callee"]) for c in p["calls"]]
    assert called == [("minutes", "call", "time.split"), ("of", "new", "Span"), ("of", "call", "minutes"), ("of", "call", "minutes"), ("overlaps", "call", "this.empty"), ("overlaps", "call", "other.contains")]
    assert p["skipped_calls"] == 1


def test_types_fields_and_heritage():
    got = spans(FILES["app/ferries/ferry.ts"])
    assert {k: v[0] for k, v in got.items() if v[0] not in ("method", "module")} == {"Deck": "type", "Class": "enum", "Ferry": "class", "seatsPer": "function"}
    # a field that holds a function is a method, other fields are none
    assert [k for k, v in got.items() if v[0] == "method"] == ["Ferry.constructor", "Ferry.capacity", "Ferry.depart"]
    p = parse_source(FILES["app/ferries/ferry.ts"], "typescript")
    assert [(p["symbols"][h["from"]]["name"], h["kind"], h["name"]) for h in p["heritage"]] == [("Ferry", "extends", "Vessel"), ("Ferry", "implements", "Timetabled")]
    assert {(i["local"], i["imported"], i["source"]) for i in p["imports"]} == {("clock", "*", "../clock.js"), ("Vessel", "Vessel", "../vessel"), ("Timetabled", "Timetabled", "../vessel"), ("axios", "default", "axios")}
    wide = parse_source("interface A extends B, C.D<number> {}\nclass E extends F(G) {}\n", "typescript")["heritage"]
    assert [h["name"] for h in wide[:2]] == ["B", "C.D"]  # without type arguments
    assert spans(FILES["app/vessel.ts"])["Vessel.capacity"][:3] == ("method", 7, 7)


def test_exports_and_re_exports():
    p = parse_source(FILES["app/ferries/index.ts"], "typescript")
    assert {r["exported"]: (r["imported"], r["source"]) for r in p["re_exports"]} == {"default": ("Ferry", "./ferry"), "Class": ("Class", "./ferry"), "*": ("*", "../clock"), "vessels": ("*", "../vessel")}
    p = parse_source("const a = 1; function b() {}\nexport { a as x, b };\nexport default a;\n", "typescript")
    assert [tuple(r.values()) for r in p["local_exports"]] == [("a", "x"), ("b", "b"), ("a", "default")]
    assert parse_source("export default class {}\n", "typescript")["symbols"][1]["name"] == "default"
    p = parse_source("export default async () => { go(); };\n", "typescript")
    assert (p["symbols"][1]["kind"], p["calls"][0]["from"], p["local_exports"]) == ("function", 1, [{"local": "default", "exported": "default"}])
    assert parse_source("export type { A } from './a';\nimport type { B } from './b';\n", "typescript")["re_exports"] == [{"exported": "A", "imported": "A", "source": "./a"}]


def test_commonjs():
    p = parse_source(FILES["tools/load.cjs"], "javascript")
    assert {i["local"]: (i["imported"], i["source"]) for i in p["imports"]} == {"fs": ("*", "fs"), "minutes": ("minutes", "../app/clock"), "Slot": ("Span", "../app/clock")}
    assert {s["name"]: s["exported"] for s in p["symbols"][1:]} == {"read": False, "load": False, "main": True}
    assert {r["exported"]: r["local"] for r in p["local_exports"]} == {"load": "load", "slot": "Slot"}
    p = parse_source("module.exports = { a, b: c, d: e() };\nmodule.exports = main;\n", "javascript")
    assert [tuple(r.values()) for r in p["local_exports"]] == [("a", "a"), ("c", "b"), ("main", "default")]
    p = parse_source("exports.run = function () { go(); };\nmodule.exports.also = run;\n", "javascript")
    assert p["symbols"][1]["name"] == "run" and p["local_exports"] == [{"local": "run", "exported": "also"}]


def test_jsx():
    p = parse_source(FILES["ui/board.tsx"], "tsx")
    assert [s["name"] for s in p["symbols"]] == ["<module>", "Row", "Board"]
    assert [(c["kind"], c["callee"]) for c in p["calls"]] == [("new", "Ferry"), ("call", "first.depart"), ("call", "toMinutes"), ("jsx", "Row"), ("jsx", "Row.Empty")]  # html elements are no calls
    assert calls("const x = <A.B c={<D/>} {...e()}>{f ? <G /> : null}</A.B>; h();", "tsx") == [("jsx", "A.B", 1), ("jsx", "D", 1), ("call", "e", 1), ("jsx", "G", 1), ("call", "h", 0)]


def test_locals_of_callbacks_are_no_module_variables():
    text = "const top = 1;\nit('x', async () => {\n  const inner = make();\n  function helper() {}\n});\n"
    assert symbols(text) == [("top", "variable"), ("helper", "function")]
    assert calls(text) == [("call", "it", 0), ("call", "make", 0)]


def test_calls_that_can_be_told_and_others():
    p = parse_source("a(); b.c(); this.d(); e.f.g(); h()(); i[0](); super.j(); k?.(); l?.m(); n`x${o()}`; import('p'); new q.R(s()); t!.u();", "typescript")
    assert [c["callee"] for c in p["calls"]] == ["a", "b.c", "this.d", "h", "k", "l.m", "n", "o", "q.R", "s"]
    assert p["skipped_calls"] == 6


@pytest.mark.parametrize("text", [
    "if (a < b && c > d) x();", "const f = <T,>(v: T) => v; x();", "foo<Bar<Baz>>(1); x();", "const r = /[/](x\\/y())/g; x();", "const s = 'a()' + \"b()\" + `c()`; x();",
    "/* y() */ x(); // z()", "const o = { a() { return 1; }, get b() { return 2; }, ['c']: 3, ...d }; x();", "label: for (const k of ks) { if (k) continue label; } x();",
    "type F = { (a: string): void } | ((b: number) => void); x();", "let v = a as unknown as B; x();", "function g(this: Foo, { a, b = 1 }: P = {}, ...rest: T[]): asserts a is B {} x();",
    "class A<T extends B = C> { @dec() private readonly p?: Map<string, () => void>; static { s; } [k: string]: any; constructor(private q: number) { super; } } x();",
    "switch (a) { case 1: { b; break; } default: c; } x();", "declare module 'm' { export function f(): void; } x();", "export abstract class Q { abstract m(a: number): void; abstract n: string } x();",
    "a\n/b/g\nx();", "const y = a ? (b) : c; x();", "do { a } while (b)\nx();", "try { a } catch { b } finally { c } x();", "const {a, b: {c}} = d; x();", "async function* h() { yield* i; for await (const j of k) {} } x();",
])
def test_reader_keeps_its_place(text):
    assert "x" in [c["callee"] for c in parse_source(text, "tsx" if "<T,>" in text else "typescript")["calls"]], text


def test_overloads_and_declarations_without_body():
    assert symbols("function f(a: string): void;\nfunction f(a: number): void;\nfunction f(a: any) {}\nclass C { m(): void; m(a?: number) {} }") == [("f", "function"), ("C", "class"), ("C.m", "method")]


def test_odd_inputs():
    assert parse_source("", "typescript")["line_count"] == 0
    assert parse_source("a\n", "typescript")["line_count"] == 2
    for text in ("{", "}", "class", "function (", "`${", "import {", "export", "<", "=> =>", "/*", "'", "((((", "@", "const", "a.b.", "new", "{{{[[[", "\x00", "é = ü()"):
        parse_source(text, "tsx")
    long = "function f" + "x" * 400 + "() {}"
    s = parse_source(long, "typescript")["symbols"][1]["signature"]
    assert len(s) == 241 and s.endswith("…")


def test_columns(spark):
    rows = [(p, c) for p, c in FILES.items()] + [("a.d.ts", "x"), ("n.ts", None)]
    df = spark.createDataFrame(rows, "path string, content string").withColumn("language", language_of(F.col("path")))
    got = {r["path"]: r["language"] for r in df.collect()}
    assert got["ui/board.tsx"] == "tsx" and got["tools/load.cjs"] == "javascript" and got["a.d.ts"] is None and got["docs/harbour.md"] is None
    p = {r["path"]: r["p"] for r in df.select("path", parsed(F.col("content"), F.col("language")).alias("p")).collect()}
    assert p["n.ts"] is None and p["docs/harbour.md"] is None and len(p["app/vessel.ts"]["symbols"]) == 6


def test_a_token_is_read_once(monkeypatch):
    """Looking ahead does not read a token again, and a slash is told from a regular expression by what stands before it."""
    from collections import Counter

    from codeloom.operators import lexer

    seen, read = Counter(), lexer.Lexer._read
    monkeypatch.setattr(lexer.Lexer, "_read", lambda self: seen.update([self.pos]) or read(self))
    text = "".join(f"const f{i} = async (n: number, m?: string): Promise<Array<number>> => {{\n  return (n) => g{i}(n, `#${{n}}`);\n}};\n" for i in range(20))
    found = parse_source(text, "typescript")
    assert len(found["symbols"]) == 21 and len(found["calls"]) == 20
    assert set(seen.values()) == {1}
    calls = parse_source("const a = b / c(1) / d(2);\nconst e = f(/g(3)/);\n", "typescript")["calls"]
    assert [c["callee"] for c in calls] == ["c", "d", "f"]


def test_statements_in_common_are_read_once(monkeypatch):
    """A new version of a file reads the statement that changed; what it gives is what a reader without memory gives."""
    text = FILES["app/ferries/ferry.ts"]
    monkeypatch.setattr(extract, "_memory", extract._Memory())
    parse_source(text, "typescript")
    tokens = []
    monkeypatch.setattr(lexer.Lexer, "_read", lambda self, read=lexer.Lexer._read: tokens.append(1) or read(self))
    again = parse_source("// moved\nconst added = go(1);\n" + text, "typescript")
    statements = len(extract._memory.kept)
    known = len(tokens)
    monkeypatch.setattr(extract, "_memory", extract._Memory())
    assert again == parse_source("// moved\nconst added = go(1);\n" + text, "typescript")
    assert statements > 1 and known * 3 < len(tokens) - known


def test_memory_changes_no_result(monkeypatch):
    """Texts cut, joined and broken at many places, each read after the others and alone."""
    pieces = [FILES["app/clock.ts"], FILES["ui/board.tsx"], FILES["tools/load.cjs"], "const r = a / b\n/c/.test(d)\n", "f()\n", "(g)\n", "type A<B> = B extends C ? D : E\n", "let t = `x${y(1)}`;", "/* open", "1e", "+2;", "'s", "async", " function h() {}", "\n<T>(u)"]
    kept = extract._Memory()
    for i in range(400):
        text = "".join(pieces[(i * k + k * k) % len(pieces)][(i * 7) % 40 * (k % 2) :] for k in range(1, 6))
        text = text[: len(text) - (i * 13) % 90]
        for language in ("typescript", "tsx", "javascript"):
            monkeypatch.setattr(extract, "_memory", extract._Memory())
            plain = parse_source(text, language)
            monkeypatch.setattr(extract, "_memory", kept)
            assert parse_source(text, language) == plain == parse_source(text, language), (text, language)
