"""Tokens of TypeScript and JavaScript, read on demand since only the parser knows where JSX and regular expressions may start."""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  #: name, num, str, tmpl, regex, op, end
    text: str
    start: int
    end: int
    newline: bool  #: a line break stands before it


_BLANK = re.compile(r"(?:[\s﻿]+|//[^\n\r  ]*|/\*[\s\S]*?(?:\*/|\Z))+")
_NAME = re.compile(r"#?[^\W\d][\w$]*|#?\$[\w$]*|#?_[\w$]*")
_NUM = re.compile(r"0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
_STR = re.compile(r"""'(?:[^'\\\n]|\\[\s\S])*'?|"(?:[^"\\\n]|\\[\s\S])*"?""")
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
_OP = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|\+\+|--|&&|\|\||\?\?|\?\.(?!\d)|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|\*\*|[\s\S]")
#: What is blank, and the token after it unless the text ends there; a slash may start a regular expression instead.
_TOKEN = re.compile(f"(?:{_BLANK.pattern})?(?:(?P<name>{_NAME.pattern})|(?P<num>{_NUM.pattern})|(?P<str>{_STR.pattern})|(?P<tmpl>`)|(?P<op>{_OP.pattern}))?")
_new = tuple.__new__
_JSX_NAME = re.compile(r"[A-Za-z_$][\w$.:-]*")

#: Names after which an operand follows, so that a slash starts a regular expression.
OPERAND_AFTER = frozenset("return typeof instanceof in of new delete void throw case do else yield await default extends".split())

#: At most this many characters after a token decide that it ends there: ``1e+5`` is one token, ``1e+`` isn't.
AHEAD = 4


class Lexer:
    def __init__(self, text: str):
        self.text = text
        self.pos = 0
        self.previous: Token | None = None
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self._known: dict[int, Token] = {}  #: tokens by the place they are read from, but for those that depend on the one before
        self._peeked: Token | None = None
        self.seen = 0  #: no token so far was told by anything from here on

    def line(self, at: int) -> int:
        """The 1-based line of an offset."""
        return bisect_right(self.lines, at)

    def _operand_due(self) -> bool:
        p = self.previous
        if p is None or p.kind == "op":
            return p is None or p.text not in (")", "]", "}", "++", "--")
        return p.kind == "name" and p.text in OPERAND_AFTER

    def peek(self) -> Token:
        token = self._peeked
        if token is None:
            token = self._peeked = self._known.get(self.pos) or self._read()
        return token

    def _read(self) -> Token:
        text, pos = self.text, self.pos
        m = _TOKEN.match(text, pos)
        kind = m.lastgroup
        self.saw(m.end())
        if kind is None:
            at = m.end()
            return Token("end", "", at, at, "\n" in m[0])
        at, end = m.span(kind)
        newline = at > pos and text.find("\n", pos, at) >= 0
        if kind == "op" and text[at] == "/":
            if self._operand_due():
                line_end = text.find("\n", at)
                self.saw(line_end if line_end >= 0 else len(text))
                if m := _REGEX.match(text, at):
                    kind, end = "regex", m.end()
            return Token(kind, text[at:end], at, end, newline)
        token = self._known[pos] = _new(Token, (kind, text[at:end], at, end, newline))
        return token

    def saw(self, end: int) -> None:
        """Notes that the text up to an offset was looked at, and the few characters after it that end a token."""
        if end + AHEAD > self.seen:
            self.seen = end + AHEAD

    def next(self) -> Token:
        token = self.peek()
        self.pos, self.previous, self._peeked = token.end, token, None
        return token

    def split(self, token: Token) -> None:
        """Puts back all of an operator but its first character: ``>>`` closes two lists of types."""
        self.pos, self.previous, self._peeked = token.start + 1, token._replace(text=token.text[0], end=token.start + 1), None

    def mark(self) -> tuple:
        return self.pos, self.previous

    def reset(self, mark: tuple) -> None:
        self.pos, self.previous = mark
        self._peeked = None

    def jump(self, at: int, previous: Token | None) -> None:
        self.pos, self.previous, self._peeked = at, previous, None

    def jsx_name(self) -> tuple[str, int]:
        """The name after ``<`` and the offset behind it."""
        at = self.pos
        if blank := _BLANK.match(self.text, at):
            at = blank.end()
        m = _JSX_NAME.match(self.text, at)
        return (m[0], m.end()) if m else ("", at)
