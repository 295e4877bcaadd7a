"""Symbols, imports, exports, calls and heritage of one TypeScript or JavaScript file.

A recursive reader over the token stream, written for these facts alone. It follows the grammar of declarations, class
bodies, object literals, functions, templates and JSX, and reads other expressions from left to right, which visits calls
in source order. It accepts what it doesn't know by skipping it, so a file is never rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from ..functions.ids import PARSER_VERSION
from .lexer import Lexer, Token

PARSE = (
    "struct<parser_version:int,language:string,line_count:int,"
    "symbols:array<struct<id:int,name:string,qualified_name:string,kind:string,start_line:int,end_line:int,signature:string,exported:boolean,parent:int>>,"
    "imports:array<struct<local:string,imported:string,source:string,line:int>>,"
    "re_exports:array<struct<exported:string,imported:string,source:string>>,"
    "local_exports:array<struct<local:string,exported:string>>,"
    "calls:array<struct<from:int,callee:string,kind:string,line:int>>,"
    "heritage:array<struct<from:int,name:string,kind:string>>,"
    "skipped_calls:int>"
)
FIELDS = ["parser_version", "language", "line_count", "symbols", "imports", "re_exports", "local_exports", "calls", "heritage", "skipped_calls"]
# Fixed value: the longest signature, after which it is cut.
MAX_SIGNATURE = 240
# Languages by extension.
EXTENSIONS = {
    ".ts": "typescript",
    ".mts": "typescript",
    ".cts": "typescript",
    ".tsx": "tsx",
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
}
MODULE = "<module>"
_CLOSE = {"(": ")", "[": "]", "{": "}"}
_MODIFIERS = frozenset("public private protected static readonly override declare abstract async accessor get set".split())
_WORDS_THAT_CONTINUE = frozenset(("in", "of", "instanceof", "as", "satisfies"))


def language_of(path: Column) -> Column:
    """The language by extension, null for declaration files and all others."""
    ext = F.regexp_extract(path, r"(\.[a-z]+)$", 1)
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.when(path.rlike(r"\.d\.[mc]?ts$"), F.lit(None).cast("string")).otherwise(F.try_element_at(known, ext))


class _Kept(NamedTuple):
    """What a statement at the top of a file gave, with offsets, lines and ids counted from its start."""

    end: int
    previous: Token
    symbols: list[dict]
    imports: list[dict]
    re_exports: list[dict]
    local_exports: list[dict]
    calls: list[dict]
    heritage: list[dict]
    skipped: int


class _Memory:
    """Statements read before in this process, by all of the text that decided how they were read: versions of a file, and
    files of one project, have most statements in common. It is emptied when it is full."""

    # The characters by which statements are looked up first, the longest text kept, texts of different lengths
    # tried after equal beginnings, and how many statements and characters are kept at most.
    HEAD, LONGEST, SIZES, MOST, MOST_CHARS = 32, 16_384, 32, 20_000, 8_000_000

    def __init__(self):
        self.sizes: dict[tuple, list[int]] = {}
        self.kept: dict[tuple, _Kept] = {}
        self.chars = 0

    def find(self, text: str, at: int, kind: tuple) -> _Kept | None:
        sizes = self.sizes.get((kind, text[at : at + self.HEAD]))
        left = len(text) - at
        for size in sizes or ():
            if size > 0 and size <= left:
                found = self.kept.get((kind, size, text[at : at + size]))
            elif size == 0 and left <= self.LONGEST:  # the end of the file was seen
                found = self.kept.get((kind, 0, text[at:]))
            else:
                continue
            if found:
                return found
        return None

    def keep(self, text: str, at: int, seen: int, kind: tuple, what: _Kept) -> None:
        size = seen - at if seen <= len(text) else 0
        piece = text[at:seen]
        if len(piece) > self.LONGEST:
            return
        if len(self.kept) >= self.MOST or self.chars + len(piece) > self.MOST_CHARS:
            self.__init__()
        sizes = self.sizes.setdefault((kind, text[at : at + self.HEAD]), [])
        if size not in sizes:
            if len(sizes) >= self.SIZES:
                return
            sizes.append(size)
        self.kept[kind, size, piece] = what
        self.chars += len(piece)


_memory = _Memory()


class _Reader:
    def __init__(self, text: str, language: str):
        self.text, self.language = text, language
        self.jsx = language != "typescript"
        self.lex = Lexer(text)
        self.hidden = 0  # anonymous functions and classes around: their variables belong to no module
        self.symbols: list[dict] = []
        self.imports: list[dict] = []
        self.re_exports: list[dict] = []
        self.local_exports: list[dict] = []
        self.calls: list[dict] = []
        self.heritage: list[dict] = []
        self.skipped = 0
        self.begun = 0  # where the statement at the top of the file starts
        self.alone = True  # whether the lexer knows all of the text that it was read by

    # ---- what is found

    def read(self) -> dict:
        lines = self.text.count("\n") + 1 if self.text else 0
        self.symbols.append({"id": 0, "name": MODULE, "qualified_name": MODULE, "kind": "module", "start_line": 1, "end_line": max(1, lines), "signature": "", "exported": False, "parent": None})
        while self.lex.peek().kind != "end":
            self.top()
        return {
            "parser_version": PARSER_VERSION, "language": self.language, "line_count": lines, "symbols": self.symbols, "imports": self.imports,
            "re_exports": self.re_exports, "local_exports": self.local_exports, "calls": self.calls, "heritage": self.heritage, "skipped_calls": self.skipped,
        }

    def top(self) -> None:
        """One statement of the file, from memory if the same text was read before."""
        lex, token, before = self.lex, self.lex.peek(), self.lex.pos
        at, kind = token.start, (self.language, token.newline)
        line, ids = lex.line(at), len(self.symbols) - 1
        if token.text != "/" and token.kind != "regex" and (old := _memory.find(self.text, at, kind)):
            self.symbols += [s | {"id": s["id"] + ids, "start_line": s["start_line"] + line, "end_line": s["end_line"] + line, "parent": s["parent"] and s["parent"] + ids} for s in old.symbols]
            self.imports += [i | {"line": i["line"] + line} for i in old.imports]
            self.re_exports += old.re_exports
            self.local_exports += old.local_exports
            self.calls += [c | {"from": c["from"] and c["from"] + ids, "line": c["line"] + line} for c in old.calls]
            self.heritage += [h | {"from": h["from"] + ids} for h in old.heritage]
            self.skipped += old.skipped
            last = old.previous
            return lex.jump(at + old.end, Token(last.kind, last.text, at + last.start, at + last.end, last.newline))
        self.begun, self.alone = at, token.text != "/" and token.kind != "regex"
        counts = [len(x) for x in (self.imports, self.re_exports, self.local_exports, self.calls, self.heritage)]
        skipped = self.skipped
        self.statement(0)
        if lex.pos == before:
            lex.next()
            return
        if not self.alone:
            return
        imports, re_exports, local_exports, calls, heritage = (x[n:] for x, n in zip((self.imports, self.re_exports, self.local_exports, self.calls, self.heritage), counts, strict=True))
        kept = _Kept(
            lex.pos - at,
            lex.previous._replace(start=lex.previous.start - at, end=lex.previous.end - at),
            [s | {"id": s["id"] - ids, "start_line": s["start_line"] - line, "end_line": s["end_line"] - line, "parent": s["parent"] and s["parent"] - ids} for s in self.symbols[ids + 1 :]],
            [i | {"line": i["line"] - line} for i in imports],
            re_exports,
            local_exports,
            [c | {"from": c["from"] and c["from"] - ids, "line": c["line"] - line} for c in calls],
            [h | {"from": h["from"] - ids} for h in heritage],
            self.skipped - skipped,
        )
        _memory.keep(self.text, at, lex.seen, kind, kept)

    def add(self, start: int, name: str, kind: str, scope: int, exported: bool = False) -> int:
        above = self.symbols[scope]
        qualified = name if above["kind"] == "module" else f"{above['qualified_name']}.{name}"
        at = self.lex.line(start)
        self.symbols.append({"id": len(self.symbols), "name": name, "qualified_name": qualified, "kind": kind, "start_line": at, "end_line": at, "signature": "", "exported": exported, "parent": scope})
        return len(self.symbols) - 1

    def finish(self, symbol: int, start: int, body: int | None, end: int) -> None:
        """Sets the lines and the signature of a symbol: the text up to its body, or else its first line."""
        whole = self.text[start:end]
        cut = body - start if body is not None else whole.find("\n")
        head = " ".join((whole[:cut] if cut > 0 else whole).split())
        head = re.sub(r"[=:]\s*$", "", head).strip()
        self.symbols[symbol] |= {"end_line": self.lex.line(max(start, end - 1)), "signature": head if len(head) <= MAX_SIGNATURE else head[:MAX_SIGNATURE] + "…"}

    def call(self, scope: int, callee: str, kind: str, start: int) -> None:
        self.calls.append({"from": scope, "callee": callee, "kind": kind, "line": self.lex.line(start)})

    # ---- small steps

    def at(self, *texts: str) -> bool:
        token = self.lex.peek()
        return token.text in texts and token.kind in ("op", "name")

    def take(self, *texts: str) -> Token | None:
        return self.lex.next() if self.at(*texts) else None

    def last_end(self) -> int:
        return self.lex.previous.end if self.lex.previous else 0

    def ahead(self) -> Token:
        """The token after the next."""
        mark = self.lex.mark()
        self.lex.next()
        token = self.lex.peek()
        self.lex.reset(mark)
        return token

    def end_statement(self) -> None:
        self.take(";")

    def skip_balanced(self) -> None:
        """From an opening bracket to behind its partner; strings, templates and comments are tokens of their own."""
        opened = [_CLOSE[self.lex.next().text]]
        while opened and self.lex.peek().kind != "end":
            token = self.lex.next()
            if token.kind == "tmpl":
                self.template(None)
            elif token.kind == "op" and token.text in _CLOSE:
                opened.append(_CLOSE[token.text])
            elif token.kind == "op" and token.text == opened[-1]:
                opened.pop()

    def skip_angles(self) -> bool:
        """Over ``<...>`` if it can be a list of types; else stays and says so."""
        mark = self.lex.mark()
        depth = 0
        while True:
            token = self.lex.peek()
            if token.kind == "op" and token.text in _CLOSE:
                self.skip_balanced()
                continue
            self.lex.next()
            if token.kind == "tmpl":
                self.template(None)
            elif token.text == "<":
                depth += 1
            elif token.kind == "op" and token.text[0] == ">" and token.text != ">=":
                if len(token.text) > 1:
                    self.lex.split(token)
                depth -= 1
                if depth == 0:
                    return True
            elif token.kind == "end" or token.kind == "regex" or token.kind == "op" and token.text not in (",", ".", "|", "&", "?", ":", "=", "=>", "...", "-", "+", ";", "@"):
                self.lex.reset(mark)
                return False

    def skip_type(self) -> None:
        """Over a type: operands joined by the operators of types."""
        while True:
            while self.at("|", "&", "keyof", "typeof", "readonly", "infer", "unique", "asserts", "new", "abstract", "-", "+") and self.lex.next():
                pass
            token = self.lex.peek()
            parameters = token.kind == "op" and token.text == "("  # of a function type, if an arrow follows
            if token.kind == "op" and token.text in _CLOSE:
                self.skip_balanced()
            elif token.text == "<":
                if not self.skip_angles():
                    return
                continue
            elif token.kind == "tmpl":
                self.lex.next()
                self.template(None)
            elif token.kind in ("name", "num", "str"):
                self.lex.next()
            else:
                return
            while True:
                token = self.lex.peek()
                if token.text == "<" and token.kind == "op":
                    if not self.skip_angles():
                        return
                elif token.text == "[" and not token.newline:
                    self.skip_balanced()
                elif token.text == ".":
                    self.lex.next()
                    self.lex.next()
                else:
                    break
            if self.at("|", "&", "?") or self.at("=>") and parameters or self.at("extends", "is") and not self.lex.peek().newline:
                self.lex.next()
            elif self.at(":") and self._conditional():
                self.lex.next()
            else:
                return

    def _conditional(self) -> bool:
        """Whether a colon belongs to a conditional type: only if one was opened, which its question mark shows nearby."""
        self.alone &= self.lex.pos - 300 >= self.begun
        text = self.text[max(0, self.lex.pos - 300) : self.lex.pos]
        return bool(re.search(r"\bextends\b[^;{}]*\?[^;:{}]*$", text))

    # ---- statements

    def block(self, scope: int) -> None:
        """``{ ... }`` of statements, case labels included."""
        self.take("{")
        while not self.at("}") and self.lex.peek().kind != "end":
            before = self.lex.pos
            if self.at("case"):
                self.lex.next()
                self.expression(scope, (":",))
                self.take(":")
            elif self.at("default") and self.ahead().text == ":":
                self.lex.next()
                self.lex.next()
            else:
                self.statement(scope)
            if self.lex.pos == before:
                self.lex.next()
        self.take("}")

    def statement(self, scope: int, exported: bool = False) -> None:
        token = self.lex.peek()
        word = token.text if token.kind == "name" else ""
        after = self.ahead() if word in ("import", "type", "async", "abstract", "declare", "namespace", "module", "global", "interface", "enum", "const", "let") else None
        if token.text == "@" and token.kind == "op":
            start = token.start
            while self.at("@"):
                self.lex.next()
                self.postfix(scope)
            if self.at("export"):
                self.export(scope)
            elif self.at("class") or self.at("abstract"):
                self.class_declaration(scope, exported, start)
            return
        if token.text == "{" and token.kind == "op":
            return self.block(scope)
        if word == "export":
            return self.export(scope)
        if word == "import" and after.text not in ("(", "."):
            return self.import_(token)
        if word == "function" or word == "async" and after.text == "function" and not after.newline:
            return self.function_declaration(scope, exported)
        if word == "class" or word == "abstract" and after.text == "class":
            return self.class_declaration(scope, exported, token.start)
        if word == "interface" and after.kind == "name":
            return self.interface(scope, exported)
        if word == "type" and after.kind == "name" and not after.newline:
            return self.type_alias(scope, exported)
        if word == "enum" and after.kind == "name" or word == "const" and after.text == "enum":
            return self.enum(scope, exported)
        if word == "declare" and after.kind == "name" and not after.newline:
            self.lex.next()
            return self.statement(scope)
        if word in ("namespace", "module") and after.kind in ("name", "str") and not after.newline or word == "global" and after.text == "{":
            while not self.at("{", ";") and self.lex.peek().kind != "end":
                self.lex.next()
            return self.block(scope) if self.at("{") else self.end_statement()
        if word in ("const", "var", "let") and (word != "let" or after.kind == "name" or after.text in ("[", "{")):
            self.variables(scope, exported)
            return self.end_statement()
        if word in ("if", "while", "switch", "with", "for", "catch"):
            return self.headed(scope)
        if word in ("else", "do", "try", "finally"):
            self.lex.next()
            return self.statement(scope)
        if word in ("return", "throw", "break", "continue", "debugger"):
            self.lex.next()
            if not self.lex.peek().newline and not self.at(";", "}"):
                self.expression(scope, ())
            return self.end_statement()
        if word and self.ahead().text == ":" and word not in ("default", "case"):
            self.lex.next()
            self.lex.next()
            return
        if scope == 0 and not self.hidden:
            self.module_exports(token)
        if not self.at(";"):
            self.expression(scope, ())
        self.end_statement()

    def headed(self, scope: int) -> None:
        """A keyword with a parenthesised head, and the statement it rules."""
        word = self.lex.next().text
        self.take("await")
        if self.at("("):
            self.lex.next()
            if word == "for" and self.at("const", "let", "var"):
                mark = self.lex.mark()
                self.lex.next()
                if self.lex.peek().kind == "op" and self.lex.peek().text in _CLOSE:
                    self.skip_balanced()
                else:
                    self.lex.next()
                if self.take(":"):
                    self.skip_type()
                if not self.take("of", "in"):
                    self.lex.reset(mark)
                    self.variables(scope, False)
            while not self.at(")") and self.lex.peek().kind != "end":
                before = self.lex.pos
                self.expression(scope, (")", ";"))
                self.take(";")
                if self.lex.pos == before:
                    self.lex.next()
            self.take(")")
        if word == "switch" or self.at("{"):
            return self.block(scope)
        self.statement(scope)

    def import_(self, start: Token) -> None:
        self.lex.next()
        line, found = self.lex.line(start.start), []
        if self.at("type") and self.ahead().text not in ("from", ",", "="):
            self.lex.next()
        while self.lex.peek().kind != "end" and not self.at("from", ";"):
            token = self.lex.peek()
            if token.kind == "str":  # nothing is bound
                self.lex.next()
                return self.end_statement()
            self.lex.next()
            if token.text == "*":
                self.take("as")
                found.append((self.lex.next().text, "*"))
            elif token.text == "{":
                found += [(alias, name) for name, alias in self.specifiers()]
            elif token.kind == "name":
                if self.at("="):  # import x = require(...) or an alias of a name
                    self.lex.next()
                    self.expression(0, (), silent=True)
                    return self.end_statement()
                found.append((token.text, "default"))
            elif token.text != ",":
                return
        if self.take("from") and self.lex.peek().kind == "str":
            source = self.lex.next().text[1:-1]
            self.imports += [{"local": a, "imported": b, "source": source, "line": line} for a, b in found]
            if self.at("with", "assert"):
                self.lex.next()
                if self.at("{"):
                    self.skip_balanced()
        self.end_statement()

    def specifiers(self) -> list[tuple[str, str]]:
        """(name, alias) of a list in braces whose opening one is behind."""
        out = []
        while not self.at("}") and self.lex.peek().kind != "end":
            name = self.lex.next()
            if name.text == "type" and name.kind == "name" and not self.at(",", "}", "as"):
                name = self.lex.next()
            alias = name
            if self.take("as"):
                alias = self.lex.next()
            if name.kind in ("name", "str"):
                out.append((name.text, alias.text))
            self.take(",")
        self.take("}")
        return out

    def export(self, scope: int) -> None:
        start = self.lex.next()
        if self.at("type") and self.ahead().text in ("{", "*"):
            self.lex.next()
        if self.take("*"):
            name = self.lex.next().text if self.take("as") else None
            if self.take("from") and self.lex.peek().kind == "str":
                self.re_exports.append({"exported": name or "*", "imported": "*", "source": self.lex.next().text[1:-1]})
            return self.end_statement()
        if self.take("{"):
            found = self.specifiers()
            if self.take("from") and self.lex.peek().kind == "str":
                source = self.lex.next().text[1:-1]
                self.re_exports += [{"exported": b, "imported": a, "source": source} for a, b in found]
            else:
                self.local_exports += [{"local": a, "exported": b} for a, b in found]
            return self.end_statement()
        if self.take("="):
            self.expression(scope, ())
            return self.end_statement()
        if not self.take("default"):
            return self.statement(scope, True)
        self.export_default(scope, start.start)

    def export_default(self, scope: int, start: int) -> None:
        count = len(self.symbols)
        if self.at("@", "abstract", "interface", "enum") and self.ahead().kind == "name" or self.declares():
            self.statement(scope, True)
            if len(self.symbols) > count:
                self.local_exports.append({"local": self.symbols[count]["name"], "exported": "default"})
            return
        kind = self.value_kind()
        if kind:
            symbol = self.add(start, "default", kind, scope, True)
            self.local_exports.append({"local": "default", "exported": "default"})
            body = self.valued(symbol, kind)
            self.end_statement()
            return self.finish(symbol, start, body, self.last_end())
        token = self.lex.peek()
        if token.kind == "name" and (self.ahead().text == ";" or self.ahead().newline or self.ahead().kind == "end"):
            self.lex.next()
            self.local_exports.append({"local": token.text, "exported": "default"})
        else:
            self.expression(scope, ())
        self.end_statement()

    def declares(self) -> bool:
        """Whether a named function or class follows."""
        mark = self.lex.mark()
        self.take("async")
        found = bool(self.take("function", "class"))
        self.take("*")
        token = self.lex.peek()
        self.lex.reset(mark)
        return found and token.kind == "name" and token.text not in ("extends", "implements")

    def function_declaration(self, scope: int, exported: bool) -> None:
        start = self.lex.peek().start
        self.take("async")
        self.lex.next()
        self.take("*")
        name = self.lex.next().text
        mark, calls = self.lex.mark(), (len(self.calls), self.skipped)
        symbol = self.add(start, name, "function", scope, exported)
        body = self.function_rest(symbol)
        if body is None:  # a signature without a body declares nothing
            self.symbols.pop()
            del self.calls[calls[0] :]
            self.skipped = calls[1]
            self.lex.reset(mark)
            self.function_rest(scope)
            return self.end_statement()
        self.finish(symbol, start, body, self.last_end())

    def function_rest(self, scope: int) -> int | None:
        """Type parameters, parameters, result type and body; the offset of the body if there is one."""
        if self.at("<"):
            self.skip_angles()
        self.parameters(scope)
        if self.take(":"):
            self.skip_type()
        if not self.at("{"):
            return None
        body = self.lex.peek().start
        self.block(scope)
        return body

    def parameters(self, scope: int) -> None:
        if not self.take("("):
            return
        while not self.at(")") and self.lex.peek().kind != "end":
            before = self.lex.pos
            while self.at("@"):
                self.lex.next()
                self.postfix(scope)
            self.expression(scope, (",", ")", ":", "?", "="))
            self.take("?")
            if self.take(":"):
                self.skip_type()
            if self.take("="):
                self.expression(scope, (",", ")"))
            self.take(",")
            if self.lex.pos == before:
                self.lex.next()
        self.take(")")

    def interface(self, scope: int, exported: bool) -> None:
        start = self.lex.next().start
        symbol = self.add(start, self.lex.next().text, "interface", scope, exported)
        if self.at("<"):
            self.skip_angles()
        if self.take("extends"):
            self.type_names(symbol, "extends")
        body = self.lex.peek().start
        if self.at("{"):
            self.skip_balanced()
        self.finish(symbol, start, body, self.last_end())

    def type_names(self, symbol: int, kind: str) -> None:
        while True:
            start = self.lex.peek().start
            self.skip_type()
            name = re.sub(r"\s+", "", re.sub(r"<[\s\S]*$", "", self.text[start : self.last_end()]))
            self.heritage.append({"from": symbol, "name": name, "kind": kind})
            if not self.take(","):
                return

    def type_alias(self, scope: int, exported: bool) -> None:
        start = self.lex.next().start
        symbol = self.add(start, self.lex.next().text, "type", scope, exported)
        if self.at("<"):
            self.skip_angles()
        body = None
        if self.take("="):
            body = self.lex.peek().start
            self.skip_type()
        end = self.last_end()
        if self.take(";"):
            end = self.last_end()
        self.finish(symbol, start, body, end)

    def enum(self, scope: int, exported: bool) -> None:
        start = self.lex.next().start
        self.take("enum")
        symbol = self.add(start, self.lex.next().text, "enum", scope, exported)
        body = self.lex.peek().start
        if self.at("{"):
            self.skip_balanced()
        self.finish(symbol, start, body, self.last_end())

    def class_declaration(self, scope: int, exported: bool, start: int) -> None:
        self.take("abstract")
        self.lex.next()
        symbol = self.add(start, self.lex.next().text, "class", scope, exported)
        self.finish(symbol, start, self.class_rest(symbol, symbol), self.last_end())

    def class_rest(self, symbol: int | None, scope: int) -> int:
        """Type parameters, heritage and body. Heritage belongs to ``symbol`` if there is one."""
        if self.at("<"):
            self.skip_angles()
        if self.take("extends"):
            start = self.lex.peek().start
            self.postfix(scope)
            if symbol is not None:
                name = re.sub(r"\s+", "", re.sub(r"<[\s\S]*$", "", self.text[start : self.last_end()]))
                self.heritage.append({"from": symbol, "name": name, "kind": "extends"})
            if self.at("<"):
                self.skip_angles()
        if self.take("implements"):
            if symbol is None:
                symbol = -1
            self.type_names(symbol, "implements")
            self.heritage = [h for h in self.heritage if h["from"] >= 0]
        body = self.lex.peek().start
        if self.take("{"):
            while not self.at("}") and self.lex.peek().kind != "end":
                before = self.lex.pos
                self.member(scope)
                if self.lex.pos == before:
                    self.lex.next()
            self.take("}")
        return body

    def member(self, scope: int) -> None:
        """A member of a class."""
        if self.take(";"):
            return
        while self.at("@"):
            self.lex.next()
            self.postfix(scope)
        start, abstract = self.lex.peek().start, False
        while self.lex.peek().kind == "name" and self.lex.peek().text in _MODIFIERS and self.ahead().text not in ("(", "=", ";", ":", "?", "!", "<", "}", ","):
            abstract |= self.lex.next().text == "abstract"
            if self.lex.previous.text == "static" and self.at("{"):
                return self.block(scope)
        self.take("*")
        name = self.member_name(scope)
        if name is None:
            return
        self.take("?", "!")
        if self.at("(", "<"):
            mark, calls = self.lex.mark(), (len(self.calls), self.skipped)
            symbol = self.add(start, name, "method", scope)
            body = self.function_rest(symbol)
            if body is None and not abstract:
                self.symbols.pop()
                del self.calls[calls[0] :]
                self.skipped = calls[1]
                self.lex.reset(mark)
                self.function_rest(scope)
            else:
                self.finish(symbol, start, body, self.last_end())
            return self.end_statement()
        if self.take(":"):
            self.skip_type()
        if self.take("="):
            if self.value_kind() == "function":
                symbol = self.add(start, name, "method", scope)
                self.finish(symbol, start, self.valued(symbol, "function"), self.last_end())
            else:
                self.expression(scope, ())
        self.end_statement()

    def member_name(self, scope: int) -> str | None:
        token = self.lex.peek()
        if token.text == "[" and token.kind == "op":
            self.lex.next()
            self.expression(scope, ("]", ":"))
            if self.take(":"):
                self.skip_type()
            self.take("]")
            return self.text[token.start : self.last_end()]
        if token.kind in ("name", "str", "num"):
            return self.lex.next().text
        return None

    def variables(self, scope: int, exported: bool) -> None:
        """The declarations after const, let or var."""
        self.lex.next()
        while True:
            token = self.lex.peek()
            pattern = None
            if token.text in ("{", "[") and token.kind == "op":
                pattern = self.lex.mark()
                self.skip_balanced()
                name = None
            elif token.kind == "name":
                name = self.lex.next().text
            else:
                return
            self.take("!")
            if self.take(":"):
                self.skip_type()
            if self.take("="):
                self.declared(token.start, name, pattern, scope, exported)
            elif name is not None and scope == 0 and not self.hidden:
                symbol = self.add(token.start, name, "variable", scope, exported)
                self.finish(symbol, token.start, None, self.last_end())
            if not self.take(","):
                return

    def declared(self, start: int, name: str | None, pattern: tuple | None, scope: int, exported: bool) -> None:
        """One declaration with a value."""
        if source := self.required():
            line = self.lex.line(start)
            bound = [(name, "*")] if name is not None else self.bound(pattern)
            self.imports += [{"local": a, "imported": b, "source": source, "line": line} for a, b in bound]
            return
        value = self.lex.peek().start
        kind = self.value_kind() if name is not None else None
        if kind:
            symbol = self.add(start, name, kind, scope, exported)
            self.finish(symbol, start, self.valued(symbol, kind), self.last_end())
        elif name is not None and scope == 0 and not self.hidden:
            symbol = self.add(start, name, "variable", scope, exported)
            self.expression(symbol, (",",))
            self.finish(symbol, start, value, self.last_end())
        else:
            self.expression(scope, (",",))

    def required(self) -> str | None:
        """The module if the value is ``require('...')`` and nothing else, which is then behind."""
        mark = self.lex.mark()
        if self.take("require") and self.take("(") and self.lex.peek().kind == "str":
            source = self.lex.next().text[1:-1]
            if self.take(")") and not self.at(".", "(", "[", "?.", "!") and self.lex.peek().kind != "tmpl":
                return source
        self.lex.reset(mark)
        return None

    def bound(self, pattern: tuple) -> list[tuple[str, str]]:
        """(local, imported) of an object pattern read before."""
        here = self.lex.mark()
        self.lex.reset(pattern)
        out = []
        if self.take("{"):
            while not self.at("}") and self.lex.peek().kind != "end":
                key = self.lex.next()
                if key.kind == "name" and self.at(",", "}"):
                    out.append((key.text, key.text))
                elif key.kind in ("name", "str") and self.take(":"):
                    value = self.lex.peek()
                    if value.kind == "name" and self.ahead().text in (",", "}"):
                        out.append((value.text, key.text))
                    self.pass_over()
                else:
                    self.pass_over()
                self.take(",")
        self.lex.reset(here)
        return out

    def pass_over(self) -> None:
        while not self.at(",", "}") and self.lex.peek().kind != "end":
            if self.at(*_CLOSE):
                self.skip_balanced()
            else:
                self.lex.next()

    # ---- functions and classes as values

    def value_kind(self) -> str | None:
        """``function`` or ``class`` if the value that follows is one as a whole."""
        mark = self.lex.mark()
        self.take("async")
        token = self.lex.peek()
        kind = None
        if token.text == "class" and token.kind == "name":
            kind = "class"
        elif token.text == "function" and token.kind == "name":
            kind = "function"
        elif token.kind == "name":
            self.lex.next()
            kind = "function" if self.at("=>") else None
        elif token.text in ("(", "<") and token.kind == "op":
            if token.text == "(" or self.skip_angles():
                if self.at("("):
                    self.skip_balanced()
                    if self.take(":"):
                        self.skip_type()
                    kind = "function" if self.at("=>") else None
        self.lex.reset(mark)
        return kind

    def valued(self, symbol: int, kind: str) -> int | None:
        """Reads such a value for a symbol; the offset of its body."""
        self.take("async")
        if kind == "class":
            self.lex.next()
            if self.lex.peek().kind == "name" and not self.at("extends", "implements"):
                self.lex.next()
            return self.class_rest(symbol, symbol)
        if self.take("function"):
            self.take("*")
            if self.lex.peek().kind == "name":
                self.lex.next()
            return self.function_rest(symbol)
        return self.arrow(symbol)

    def arrow(self, scope: int) -> int:
        if self.at("<"):
            self.skip_angles()
        if self.at("("):
            self.parameters(scope)
            if self.take(":"):
                self.skip_type()
        else:
            self.lex.next()
        self.take("=>")
        body = self.lex.peek().start
        if self.at("{"):
            self.block(scope)
        else:
            self.expression(scope, (",",))
        return body

    # ---- expressions

    def expression(self, scope: int, stops: tuple[str, ...], silent: bool = False) -> None:
        """Reads operands and operators up to a closing bracket, a semicolon, one of ``stops``, or a line break that ends
        the statement."""
        operand = False  # whether an operand was just read
        first = True
        while True:
            token = self.lex.peek()
            if token.kind == "end" or token.kind == "op" and token.text in (")", "]", "}", ";", *stops):
                return
            if operand and token.newline and not first and not self._continues(token):
                return
            if token.kind == "op" and token.text == "=>":
                self.lex.next()
                self.hidden += 1
                if self.at("{"):
                    self.block(scope)
                else:
                    self.expression(scope, (*stops, ","))
                self.hidden -= 1
                operand = True
            elif token.kind == "op" and not self._operand(token, operand):
                self.lex.next()
                operand = token.text in ("++", "--") and operand
            elif token.kind == "name" and operand and token.text in _WORDS_THAT_CONTINUE:
                self.lex.next()
                if token.text in ("as", "satisfies"):
                    self.skip_type()
                else:
                    operand = False
            elif token.kind == "name" and token.text in ("typeof", "void", "delete", "await", "yield", "in", "of", "instanceof", "throw", "case", "return", "else"):
                self.lex.next()
                operand = False
            else:
                self.postfix(scope, silent)
                operand = True
            first = False

    def _operand(self, token: Token, operand: bool) -> bool:
        """Whether an operator starts an operand here."""
        return token.text in _CLOSE or token.text in ("<", "@") and not operand

    def _continues(self, token: Token) -> bool:
        """Whether a token on a new line goes on with the expression."""
        if token.kind == "op":
            return token.text not in ("{", "@", "!", "~", "++", "--")
        return token.kind == "tmpl" or token.kind == "name" and token.text in ("in", "instanceof", "of")

    def postfix(self, scope: int, silent: bool = False) -> None:
        """An operand with its members, calls and templates. Only the first call of a chain can be told what it calls."""
        start = self.lex.peek().start
        shape = self.primary(scope)  # the callee so far: a name, "this", or None
        while True:
            token = self.lex.peek()
            if token.kind == "tmpl":
                if token.newline and shape is None:
                    return
                self._called(scope, shape, start, silent)
                self.lex.next()
                self.template(scope)
                shape = None
            elif token.kind != "op":
                return
            elif token.text in (".", "?."):
                self.lex.next()
                if self.at("(", "["):
                    continue
                name = self.lex.next().text
                shape = f"{shape}.{name}" if shape and "." not in shape else None
            elif token.text == "(":
                self._called(scope, shape, start, silent)
                self.group(scope)
                shape = None
            elif token.text == "[":
                self.group(scope)
                shape = None
            elif token.text == "!" and not token.newline:
                self.lex.next()
                if self.at("=") or self.at("=="):
                    continue
                shape = None
            elif token.text == "<" and shape and self.language != "javascript":
                mark = self.lex.mark()
                if not self.skip_angles() or not (self.at("(") or self.lex.peek().kind == "tmpl"):
                    self.lex.reset(mark)
                    return
            else:
                return

    def _called(self, scope: int, shape: str | None, start: int, silent: bool) -> None:
        if silent or shape == "require":
            return
        if shape and shape not in ("this", "super", "import") and not shape.startswith(("super.", "import.")):
            self.call(scope, shape, "call", start)
        else:
            self.skipped += 1

    def group(self, scope: int) -> None:
        """A bracketed list of expressions."""
        close = _CLOSE[self.lex.next().text]
        while not self.at(close) and self.lex.peek().kind != "end":
            before = self.lex.pos
            self.expression(scope, (close,))
            if not self.at(close) and self.lex.pos == before:
                self.lex.next()
        self.take(close)

    def primary(self, scope: int) -> str | None:
        token = self.lex.peek()
        if token.kind == "tmpl":
            self.lex.next()
            self.template(scope)
        elif token.kind == "op" and token.text == "{":
            self.object(scope)
        elif token.kind == "op" and token.text in _CLOSE:
            self.group(scope)
        elif token.kind == "op" and token.text == "<":
            self.angled(scope)
        elif token.kind == "op" and token.text == "@":
            self.lex.next()
        elif token.kind != "name":
            self.lex.next()
        elif token.text == "function" or token.text == "async" and self.ahead().text == "function":
            self.hidden += 1
            self.take("async")
            self.lex.next()
            self.take("*")
            if self.lex.peek().kind == "name":
                self.lex.next()
            self.function_rest(scope)
            self.hidden -= 1
        elif token.text == "class":
            self.class_value(scope)
        elif token.text == "new":
            self.new(scope)
        elif token.text == "async" and (self.ahead().kind == "name" or self.ahead().text == "<" or self.value_kind() == "function"):
            self.lex.next()
        else:
            self.lex.next()
            return token.text
        return None

    def class_value(self, scope: int) -> None:
        start = self.lex.next().start
        if self.lex.peek().kind == "name" and not self.at("extends", "implements"):
            symbol = self.add(start, self.lex.next().text, "class", scope)
            return self.finish(symbol, start, self.class_rest(symbol, symbol), self.last_end())
        self.hidden += 1
        self.class_rest(None, scope)
        self.hidden -= 1

    def new(self, scope: int) -> None:
        start = self.lex.next().start
        token = self.lex.peek()
        if token.text == "." and token.kind == "op":  # new.target
            self.lex.next()
            self.lex.next()
            return
        if token.kind == "name" and token.text not in ("class", "function", "new"):
            shape: str | None = self.lex.next().text
            while self.at("."):
                self.lex.next()
                name = self.lex.next().text
                shape = f"{shape}.{name}" if shape and "." not in shape else None
            if shape and shape != "this":
                self.call(scope, shape, "new", start)
        else:
            self.primary(scope)
        if self.at("<"):
            self.skip_angles()
        if self.at("("):
            self.group(scope)

    def object(self, scope: int) -> None:
        self.take("{")
        while not self.at("}") and self.lex.peek().kind != "end":
            before = self.lex.pos
            if self.take("..."):
                self.expression(scope, (",",))
            else:
                start = self.lex.peek().start
                while self.at("async", "get", "set") and self.ahead().text not in (",", ":", "(", "}", "=", "<"):
                    self.lex.next()
                self.take("*")
                name = self.member_name(scope)
                if name is not None and self.at("(", "<"):
                    symbol = self.add(start, name, "method", scope)
                    self.finish(symbol, start, self.function_rest(symbol), self.last_end())
                elif self.take(":", "="):
                    self.expression(scope, (",",))
            self.take(",")
            if self.lex.pos == before:
                self.lex.next()
        self.take("}")

    def template(self, scope: int | None) -> None:
        """The rest of a template behind its opening mark; what stands in ``${}`` is read as an expression."""
        at, text = self.lex.pos, self.text
        while at < len(text):
            if text[at] == "\\":
                at += 2
            elif text[at] == "`":
                at += 1
                break
            elif text.startswith("${", at):
                self.lex.jump(at + 2, Token("op", "{", at + 1, at + 2, False))
                if scope is None:
                    while not self.at("}") and self.lex.peek().kind != "end":
                        if self.at(*_CLOSE):
                            self.skip_balanced()
                        elif self.lex.next().kind == "tmpl":
                            self.template(None)
                else:
                    self.expression(scope, ())
                self.take("}")
                at = self.lex.pos
            else:
                at += 1
        self.lex.saw(at)
        self.lex.jump(at, Token("str", "`", at - 1, at, False))

    # ---- JSX

    def angled(self, scope: int) -> None:
        """``<`` where an operand is due: type parameters of an arrow, a cast, or an element."""
        mark = self.lex.mark()
        if self.jsx:
            self.alone = False  # elements are read past the lexer
            self.lex.next()
            name, behind = self.lex.jsx_name()
            rest = self.text[behind : behind + 20].lstrip()
            generic = self.language == "tsx" and (rest.startswith(",") or rest.startswith("extends "))
            if not generic and (name or rest.startswith(">")):
                return self.element(scope, self.lex.previous.start)
            self.lex.reset(mark)
        if not self.skip_angles():
            self.lex.next()

    def element(self, scope: int, start: int) -> None:
        """An element whose ``<`` is behind."""
        name, behind = self.lex.jsx_name()
        self.lex.jump(behind, Token("str", name, behind, behind, False))
        if re.match(r"[A-Z]", name) and re.fullmatch(r"[A-Za-z0-9_.]+", name):
            self.call(scope, name, "jsx", start)
        if self.at("<"):
            self.skip_angles()
        while True:  # attributes
            token = self.lex.peek()
            if token.kind == "end":
                return
            if token.text == "{" and token.kind == "op":
                self.lex.next()
                self.take("...")
                self.expression(scope, ())
                self.take("}")
            elif token.text == "<" and token.kind == "op":
                self.lex.next()
                self.element(scope, token.start)
            elif token.text == "/" and token.kind == "op":
                self.lex.next()
                close = self.lex.peek()
                self.lex.jump(close.start + 1, Token("str", "", close.start, close.start + 1, False))
                return
            elif token.kind == "op" and token.text[0] == ">":
                self.lex.jump(token.start + 1, None)
                break
            elif token.kind == "regex":  # a slash and the end of the tag, taken for a regular expression
                self.lex.jump(token.start + 2, Token("str", "", token.start, token.start + 2, False))
                return
            elif token.kind == "op" and token.text == "=":
                self.lex.next()
                quote = self.lex.peek()
                if quote.kind == "str" or self.text[quote.start : quote.start + 1] in "'\"":  # no escapes in attributes
                    end = self.text.find(self.text[quote.start], quote.start + 1)
                    end = len(self.text) if end < 0 else end + 1
                    self.lex.jump(end, Token("str", "", quote.start, end, False))
            else:
                self.lex.next()
        self.content(scope)

    def content(self, scope: int) -> None:
        """Children up to and including the closing tag."""
        text = self.text
        while True:
            at = self.lex.pos
            while at < len(text) and text[at] not in "<{":
                at += 1
            if at >= len(text):
                return self.lex.jump(at, None)
            if text[at] == "{":
                self.lex.jump(at + 1, Token("op", "{", at, at + 1, False))
                self.take("...")
                self.expression(scope, ())
                self.take("}")
            elif text[at + 1 : at + 2] == "/":
                end = text.find(">", at)
                end = len(text) if end < 0 else end + 1
                return self.lex.jump(end, Token("str", "", at, end, False))
            else:
                self.lex.jump(at + 1, Token("op", "<", at, at + 1, False))
                self.element(scope, at)

    # ---- CommonJS

    def module_exports(self, start: Token) -> None:
        """``module.exports = ...`` and ``exports.name = ...`` at the start of a statement; the statement is then read again
        as any other."""
        mark = self.lex.mark()
        path = []
        while self.lex.peek().kind == "name":
            path.append(self.lex.next().text)
            if not self.take("."):
                break
        if not (path and self.at("=")) or self.lex.previous.text == ".":
            return self.lex.reset(mark)
        self.lex.next()
        if path == ["module", "exports"]:
            self.exported_object()
        elif (path[:-1] == ["exports"] or path[:-1] == ["module", "exports"]) and len(path) > 1:
            self.exported_member(start.start, path[-1])
        self.lex.reset(mark)

    def exported_object(self) -> None:
        token = self.lex.peek()
        if token.kind == "name" and (self.ahead().text == ";" or self.ahead().newline or self.ahead().kind == "end"):
            self.local_exports.append({"local": token.text, "exported": "default"})
        elif self.at("{"):
            self.local_exports += [{"local": a, "exported": b} for a, b in self.bound(self.lex.mark())]

    def exported_member(self, start: int, name: str) -> None:
        kind = self.value_kind()
        token = self.lex.peek()
        if kind:
            symbol = self.add(start, name, kind, 0, True)
            body = self.valued_plain(symbol, kind)
            self.end_statement()
            self.finish(symbol, start, body, self.last_end())
        elif token.kind == "name" and (self.ahead().text == ";" or self.ahead().newline or self.ahead().kind == "end"):
            self.local_exports.append({"local": token.text, "exported": name})

    def valued_plain(self, symbol: int, kind: str) -> int | None:
        """A function or class without its heritage, which belongs to declarations only."""
        heritage = len(self.heritage)
        body = self.valued(symbol, kind)
        if kind == "class":
            del self.heritage[heritage:]
        return body


def parse_source(text: str, language: str) -> dict:
    """Everything extracted from one file's content; independent of its path."""
    return _Reader(text, language).read()


def parsed(content: Column, language: Column) -> Column:
    """parse_source as a column, in Arrow batches; null for null content. Filter files before: no filter passes it. Equal
    texts that follow each other are read once."""
    kind = to_arrow_type(DataType.fromDDL(PARSE))

    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        last, found = None, None
        for texts, languages in parts:
            out = []
            for one in zip(texts.to_pylist(), languages.to_pylist(), strict=True):
                if one != last:
                    last, found = one, parse_source(one[0] or "", one[1] or "")
                out.append(found)
            yield pa.array(out, kind)

    run.__annotations__ = {"parts": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.when(content.isNotNull() & language.isNotNull(), F.arrow_udf(run, PARSE)(content, language))
