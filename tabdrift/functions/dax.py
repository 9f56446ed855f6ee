"""Measure expressions: a hash of their meaning that ignores case of names, comments, blanks and needless brackets."""

from __future__ import annotations

import re

from .mquery import digest

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\r\n]*|--[^\r\n]*|/\*.*?\*/)
    | (?P<str>"(?:[^"]|"")*")
    | (?P<quoted>'(?:[^']|'')*')
    | (?P<column>\[(?:[^\]]|\]\])*\])
    | (?P<num>(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)
    | (?P<ident>[^\W\d][\w.]*)
    | (?P<op>&&|\|\||<=|>=|<>|==|[-+*/^&=<>(){},;@!])""",
    re.X | re.S,
)
_STRENGTH = {"||": 1, "or": 1, "&&": 2, "and": 2, "in": 3, "=": 3, "==": 3, "<>": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "&": 4, "+": 5, "-": 5, "*": 6, "/": 6, "^": 8}


class Unreadable(ValueError):
    """Not an expression that this parser knows."""


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise Unreadable(f"at {at}")
        at = m.end()
        if m.lastgroup != "skip":
            word = m[0]
            out.append((m.lastgroup, word if m.lastgroup == "str" else word.lower()))
    return out


class _Reader:
    def __init__(self, text: str):
        self.ts, self.at = tokens(text.strip().removeprefix("=")), 0

    def take(self, word: str) -> bool:
        hit = self.at < len(self.ts) and self.ts[self.at][0] in ("op", "ident") and self.ts[self.at][1] == word
        self.at += hit
        return hit

    def need(self, word: str) -> None:
        if not self.take(word):
            raise Unreadable(f"{word} is missing")

    def whole(self) -> tuple:
        variables = []
        while self.take("var"):
            kind, name = self.ts[self.at] if self.at < len(self.ts) else ("", "")
            if kind != "ident":
                raise Unreadable("a variable has no name")
            self.at += 1
            self.need("=")
            variables.append((name, self.infix(0)))
        if variables:
            self.need("return")
            return ("var", tuple(variables), self.infix(0))
        return self.infix(0)

    def infix(self, least: int) -> tuple:
        if self.at < len(self.ts) and self.ts[self.at] in (("op", "-"), ("op", "+"), ("op", "!"), ("ident", "not")):
            self.at += 1
            left = ("unary", self.ts[self.at - 1][1], self.infix(7))
        else:
            left = self.single()
        while self.at < len(self.ts) and self.ts[self.at][0] in ("op", "ident") and _STRENGTH.get(self.ts[self.at][1], -1) >= least:
            op = self.ts[self.at][1]
            self.at += 1
            left = ("binary", {"or": "||", "and": "&&"}.get(op, op), left, self.infix(_STRENGTH[op] + (op != "^")))
        return left

    def listed(self, end: str) -> tuple:
        out = []
        while not self.take(end):
            out.append(self.whole())
            if not (self.take(",") or self.take(";")) and not (self.at < len(self.ts) and self.ts[self.at][1] == end):
                raise Unreadable(f"{end} is missing")
        return tuple(out)

    def single(self) -> tuple:
        if self.at == len(self.ts):
            raise Unreadable("ends early")
        kind, word = self.ts[self.at]
        self.at += 1
        if word == "(" and kind == "op":
            inner = self.listed(")")
            return inner[0] if len(inner) == 1 else ("tuple", inner)
        if word == "{" and kind == "op":
            return ("table", self.listed("}"))
        if kind == "op" and word != "@":
            raise Unreadable(f"unexpected {word}")
        if kind == "ident" and self.take("("):
            return ("call", word, self.listed(")"))
        if kind in ("ident", "quoted") and self.at < len(self.ts) and self.ts[self.at][0] == "column":
            self.at += 1
            return ("column", word.strip("'"), self.ts[self.at - 1][1])
        return (kind, repr(float(word)) if kind == "num" else word.strip("'") if kind == "quoted" else word)


def semantic_hash(text: str | None) -> str | None:
    """None where the expression can't be read."""
    if text is None:
        return None
    try:
        reader = _Reader(text)
        tree = reader.whole()
    except (Unreadable, RecursionError):
        return None
    return digest(tree) if reader.at == len(reader.ts) else None
