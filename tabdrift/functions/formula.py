"""Cell formulas: parsing to nested tuples, a canonical form, shifting of relative references, and what changed between two.

Nodes: ("num", text), ("str", s), ("bool", b), ("err", text), ("name", s), ("ref", sheet, row, col, spill), ("range", a, b),
("call", name, args), ("unary", op, x), ("binary", op, x, y), ("array", rows). A row or column of a reference is
(mode, number), mode being "abs", "rel" or "off" (an offset of the R1C1 style), or None where a range has no bound."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batch import batched

_SHEET = r"(?:'(?:[^']|'')*'|\[[^\]!]*\][^!'\s]*|[A-Za-z_][A-Za-z0-9_.]*(?:\s*:\s*[A-Za-z_][A-Za-z0-9_.]*)?)\s*!"
_TOKEN = re.compile(
    rf"""\s*(?:
      (?P<str>"(?:[^"]|"")*")
    | (?P<err>\#(?:N/A|VALUE!|REF!|DIV/0!|NUM!|NAME\?|NULL!|SPILL!|CALC!|GETTING_DATA|FIELD!|BLOCKED!|CONNECT!|UNKNOWN!))
    | (?P<rows>(?P<rows_sheet>{_SHEET})?\s*(?P<ra>\$?[0-9]+)\s*:\s*(?P<rb>\$?[0-9]+)(?![A-Za-z0-9_.]))
    | (?P<num>(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)
    | (?P<cols>(?P<cols_sheet>{_SHEET})?\s*(?P<ca>\$?[A-Za-z]{{1,3}})\s*:\s*(?P<cb>\$?[A-Za-z]{{1,3}})(?![A-Za-z0-9_.(!]))
    | (?P<ref>(?P<ref_sheet>{_SHEET})?\s*(?P<a1>\$?[A-Za-z]{{1,3}}\$?[0-9]+)(?P<spill>\#)?(?![A-Za-z0-9_.(]))
    | (?P<r1c1>(?P<rc_sheet>{_SHEET})?\s*(?P<rc>[Rr](?:[0-9]+|\[[+-]?[0-9]+\])?[Cc](?:[0-9]+|\[[+-]?[0-9]+\])?)(?![A-Za-z0-9_.(]))
    | (?P<name>(?:{_SHEET})?\s*[A-Za-z_\\][A-Za-z0-9_.\\?]*(?:\[(?:[^\[\]]|\[[^\[\]]*\])*\])?)
    | (?P<op><=|>=|<>|[-+*/^&=<>%(){{}}\[\],;:@])
    )""",
    re.X,
)
#: Infix operators: strength to the left and to the right; the power operator groups from the right.
_STRENGTH = {"=": (1, 2), "<>": (1, 2), "<": (1, 2), "<=": (1, 2), ">": (1, 2), ">=": (1, 2), "&": (3, 4), "+": (5, 6), "-": (5, 6), "*": (7, 8), "/": (7, 8), "^": (9, 9)}
_PREFIX = 11
_ANY_ORDER = {"SUM", "PRODUCT", "MIN", "MAX", "AND", "OR"}
_SYMMETRIC = {"+", "*", "=", "<>"}


class Unreadable(ValueError):
    """Not a formula that this parser knows."""


def _col(text: str) -> tuple:
    n = 0
    for c in text.lstrip("$").upper():
        n = n * 26 + ord(c) - 64
    return ("abs" if text[0] == "$" else "rel", n)


def _row(text: str) -> tuple:
    return ("abs" if text[0] == "$" else "rel", int(text.lstrip("$")))


def _sheet(text: str | None) -> str | None:
    if text is None:
        return None
    text = text.rstrip().removesuffix("!").strip()
    return text[1:-1].replace("''", "'") if text.startswith("'") else text


def _a1(text: str, sheet: str | None, spill: bool) -> tuple:
    m = re.fullmatch(r"(\$?[A-Za-z]+)(\$?[0-9]+)", text)
    if m[2].lstrip("$") == "0":
        raise Unreadable(text)
    return ("ref", sheet, _row(m[2]), _col(m[1]), spill)


def _r1c1(text: str, sheet: str | None) -> tuple:
    m = re.fullmatch(r"[Rr]([0-9]+|\[[+-]?[0-9]+\])?[Cc]([0-9]+|\[[+-]?[0-9]+\])?", text)
    part = lambda x: ("off", 0) if x is None else ("off", int(x[1:-1])) if x[0] == "[" else ("abs", int(x))
    return ("ref", sheet, part(m[1]), part(m[2]), False)


def tokens(text: str) -> list[tuple]:
    out, at = [], 0
    text = text.strip()
    at = 1 if text.startswith("=") else 0
    while at < len(text):
        if text[at:].isspace():
            break
        m = _TOKEN.match(text, at)
        if not m:
            raise Unreadable(f"at {at}: {text[at : at + 10]!r}")
        kind = m.lastgroup if m.lastgroup in ("str", "err", "rows", "num", "cols", "ref", "r1c1", "name", "op") else next(k for k in ("rows", "cols", "ref", "r1c1") if m[k])
        out.append((kind, m))
        at = m.end()
    return out


class _Reader:
    def __init__(self, text: str):
        self.tokens, self.at = tokens(text), 0

    def next_op(self) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "op":
            return self.tokens[self.at][1]["op"]
        return None

    def take(self, op: str) -> bool:
        hit = self.next_op() == op
        self.at += hit
        return hit

    def need(self, op: str) -> None:
        if not self.take(op):
            raise Unreadable(f"{op} is missing")

    def expression(self, least: int = 0) -> tuple:
        op = self.next_op()
        if op in ("+", "-", "@"):
            self.at += 1
            left = ("unary", op, self.expression(_PREFIX))
        else:
            left = self.single()
        while True:
            while self.take("%"):
                left = ("unary", "%", left)
            op = self.next_op()
            if op not in _STRENGTH or _STRENGTH[op][0] < least:
                return left
            self.at += 1
            left = ("binary", op, left, self.expression(_STRENGTH[op][1]))

    def single(self) -> tuple:
        if self.at == len(self.tokens):
            raise Unreadable("ends early")
        kind, m = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return ("str", m["str"][1:-1].replace('""', '"'))
        if kind == "num":
            return ("num", repr(float(m["num"])))
        if kind == "err":
            return ("err", m["err"].upper())
        if kind == "rows":
            sheet = _sheet(m["rows_sheet"])
            return ("range", ("ref", sheet, _row(m["ra"]), None, False), ("ref", None, _row(m["rb"]), None, False))
        if kind == "cols":
            sheet = _sheet(m["cols_sheet"])
            return ("range", ("ref", sheet, None, _col(m["ca"]), False), ("ref", None, None, _col(m["cb"]), False))
        if kind in ("ref", "r1c1"):
            return self.reference(kind, m)
        if kind == "name":
            return self.named(re.sub(r"\s*!\s*", "!", m["name"].strip()))
        if m["op"] == "(":
            inner = self.expression()
            self.need(")")
            return inner
        if m["op"] == "{":
            rows = [[]]
            while True:
                rows[-1].append(self.expression())
                if self.take(";"):
                    rows.append([])
                elif not self.take(","):
                    break
            self.need("}")
            return ("array", tuple(map(tuple, rows)))
        raise Unreadable(f"unexpected {m['op']}")

    def one(self, kind: str, m) -> tuple:
        return _a1(m["a1"], _sheet(m["ref_sheet"]), bool(m["spill"])) if kind == "ref" else _r1c1(m["rc"], _sheet(m["rc_sheet"]))

    def reference(self, kind: str, m) -> tuple:
        start = self.one(kind, m)
        if self.next_op() == ":" and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][0] in ("ref", "r1c1"):
            self.at += 2
            return ("range", start, self.one(*self.tokens[self.at - 1]))
        return start

    def named(self, name: str) -> tuple:
        if self.take("("):
            args = []
            while not self.take(")"):
                args.append(("none",) if self.next_op() in (",", ";") else self.expression())
                if self.next_op() == ")":
                    continue
                if not (self.take(",") or self.take(";")):
                    raise Unreadable("a comma is missing")
            return ("call", name, tuple(args))
        if name.upper() in ("TRUE", "FALSE"):
            return ("bool", name.upper() == "TRUE")
        return ("name", name)


def parse(text: str) -> tuple:
    reader = _Reader(text)
    out = reader.expression()
    if reader.at != len(reader.tokens):
        raise Unreadable("more after the formula's end")
    return out


def canonical(e: tuple) -> tuple:
    """Names and sheets in capitals, ends of ranges in order, arguments of symmetric functions and operators sorted."""
    upper = lambda s: s and s.upper()
    if e[0] == "name":
        return ("name", e[1].upper())
    if e[0] == "ref":
        return ("ref", upper(e[1]), *e[2:])
    if e[0] == "range":
        a, b = canonical(e[1]), canonical(e[2])
        sheet = a[1] if a[1] is not None else b[1]
        a, b = ("ref", None, *a[2:]), ("ref", None, *b[2:])
        place = lambda r: [(p[1], p[0]) if p else (0, "") for p in r[2:4]]
        return ("range", sheet, *sorted((a, b), key=place))
    if e[0] == "call":
        name, args = e[1].upper(), tuple(canonical(x) for x in e[2])
        return ("call", name, tuple(sorted(args, key=repr)) if name in _ANY_ORDER else args)
    if e[0] == "unary":
        return ("unary", e[1], canonical(e[2]))
    if e[0] == "binary":
        sides = canonical(e[2]), canonical(e[3])
        return ("binary", e[1], *(sorted(sides, key=repr) if e[1] in _SYMMETRIC else sides))
    if e[0] == "array":
        return ("array", tuple(tuple(canonical(x) for x in row) for row in e[1]))
    return e


def shifted(e: tuple, rows: int, cols: int) -> tuple:
    """With relative references moved; absolute ones and offsets stay. Nothing moves before the first row or column."""
    move = lambda p, by: (p[0], max(p[1] + by, 0)) if p and p[0] == "rel" else p
    if e[0] == "ref":
        return ("ref", e[1], move(e[2], rows), move(e[3], cols), e[4])
    if e[0] == "array":
        return ("array", tuple(tuple(shifted(x, rows, cols) for x in row) for row in e[1]))
    if e[0] == "call":
        return ("call", e[1], tuple(shifted(x, rows, cols) for x in e[2]))
    if e[0] in ("unary", "binary"):
        return (*e[:2], *[shifted(x, rows, cols) for x in e[2:]])
    return ("range", shifted(e[1], rows, cols), shifted(e[2], rows, cols)) if e[0] == "range" else e


def change(old: str | None, new: str | None, rows: int = 0, cols: int = 0, semantic: bool = True) -> str:
    """Unchanged, Added, Removed, TextChange, FormattingOnly, Filled or SemanticChange."""
    if old == new:
        return "Unchanged"
    if old is None or new is None:
        return "Added" if old is None else "Removed"
    if not semantic:
        return "TextChange"
    try:
        a, b = parse(old), canonical(parse(new))
    except (Unreadable, RecursionError):
        return "TextChange"
    if canonical(a) == b:
        return "FormattingOnly"
    return "Filled" if (rows or cols) and canonical(shifted(a, rows, cols)) == b else "SemanticChange"


def plain_change(old: Column, new: Column) -> Column:
    """change without looking into formulas, in SQL functions."""
    return F.when(old.eqNullSafe(new), "Unchanged").when(old.isNull(), "Added").when(new.isNull(), "Removed").otherwise("TextChange")


def with_change(df: DataFrame, old: str, new: str, rows: Column, cols: Column, name: str = "formula_diff") -> DataFrame:
    """df with the change of two formula columns. Equal and one-sided pairs are settled in SQL; of the others each
    distinct one (formulas and shift) is parsed once, in batches."""
    judged = batched(change, "string")
    keyed = df.withColumn("__r", rows.cast("int")).withColumn("__c", cols.cast("int"))
    keys = [F.col(old).alias("__old"), F.col(new).alias("__new"), "__r", "__c"]
    two = keyed.select(*keys).where("__old is not null and __new is not null and __old <> __new").distinct()
    found = two.withColumn("__change", judged("__old", "__new", "__r", "__c"))
    on = [keyed[old] == found["__old"], keyed[new] == found["__new"], keyed["__r"] == found["__r"], keyed["__c"] == found["__c"]]
    out = keyed.join(found, on, "left").select(*[keyed[c] for c in df.columns], F.coalesce(found["__change"], plain_change(keyed[old], keyed[new])).alias(name))
    return out
