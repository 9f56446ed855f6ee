"""License scans: an Aho-Corasick automaton over the words of a text finds identifier tags and notice phrases; a
shunting-yard parser evaluates the and/or/with expressions that follow a tag.

Cases: a null or empty text has no words, no label and score 0; texts are scanned whole; overlapping phrases all count;
only licence identifiers give labels of an expression, words of prose and NOASSERTION never; a malformed expression
gives the labels of the identifiers in it; repeated rows each get a row; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame

from .common import words_of

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notice phrases as words, their label, and how much one such notice says.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.8),
    "licensed under the apache license": ("apache", 0.8),
    "gnu general public license": ("gpl", 0.7),
    "gnu affero general public license": ("agpl", 0.8),
    "gnu lesser general public license": ("lgpl", 0.8),
    "mozilla public license": ("mpl", 0.7),
    "eclipse public license": ("epl", 0.7),
    "boost software license": ("bsl", 0.7),
    "bsd license": ("bsd", 0.6),
    "redistribution and use in source and binary forms": ("bsd", 0.8),
    "isc license": ("isc", 0.6),
    "creative commons attribution": ("cc-by", 0.6),
    "all rights reserved": ("reserved", 0.4),
}
BASE_WEIGHT, TAG_WEIGHT = 0.6, 0.9
TAG = "spdx license identifier"
_TAG = re.compile(r"SPDX-License-Identifier[\x20\t]*:[\x20\t]*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
#: Licence identifiers in lower case, as patterns by family, and the family's label.
KNOWN = tuple(
    (re.compile(pattern), label)
    for pattern, label in (
        (r"mit(-0|-cmu|-feh|-enna|-wu|-advertising|-modern-variant)?", "mit"),
        (r"apache(-1\.[01]|-2\.0)?\+?", "apache"),
        (r"agpl(-[13]\.0)?(\+|-only|-or-later)?", "agpl"),
        (r"lgpl(-2\.[01]|-3\.0)?(\+|-only|-or-later)?", "lgpl"),
        (r"gpl(-[123]\.0)?(\+|-only|-or-later|-with-[a-z0-9.-]+)?", "gpl"),
        (r"mpl(-1\.[01]|-2\.0(-no-copyleft-exception)?)?\+?", "mpl"),
        (r"epl(-[12]\.0)?", "epl"),
        (r"0bsd|bsd(-[1-4]-clause(-[a-z-]+)?)?", "bsd"),
        (r"isc|bsl-1\.0|zlib|x11|ncsa|unlicense|wtfpl|postgresql|curl|libpng|openssl|vim|ruby|hpnd|icu", ""),
        (r"cc0-1\.0|cc-by-(nc-)?(sa-|nd-)?[1-4]\.0|cc-by(-sa|-nc|-nd|-nc-sa|-nc-nd)?", ""),
        (r"(artistic|python|psf|afl|cddl|cpl|ecl|eupl|ofl|osl|upl|php|zpl|cecill|busl|sspl)-[0-9]+(\.[0-9]+)*", ""),
        (r"ms-(pl|rl)|licenseref-[a-z0-9.-]+|documentref-[a-z0-9.-]+:licenseref-[a-z0-9.-]+", ""),
    )
)
#: What may stand right of with.
EXCEPTION = re.compile(r"[a-z0-9.+-]*exception[a-z0-9.+-]*|bison-exception-2\.2|llvm-exception|linux-syscall-note|ocaml-lgpl-linking-exception", re.I)
PERMISSIVE = {"mit", "apache", "bsd", "isc", "bsl-1.0", "cc-by", "cc0-1.0", "zlib", "x11", "ncsa", "unlicense", "postgresql", "curl", "libpng"}
RANK = {"or": 1, "and": 2, "with": 3}


def label_of(name: str) -> str | None:
    """The label of a licence identifier; None for what isn't one. Creative commons ones share cc-by but for cc0."""
    low = name.lower()
    for pattern, label in KNOWN:
        if pattern.fullmatch(low):
            return label or ("cc-by" if low.startswith("cc-by") else low)
    return None


def to_postfix(expression: str) -> list[str]:
    """Operators after their operands; with binds tighter than and, and tighter than or. ValueError if malformed."""
    out: list[str] = []
    held: list[str] = []
    operand = False  # whether an operand stands to the left
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if low in RANK:
            if not operand:
                raise ValueError(expression)
            while held and held[-1] != "(" and RANK[held[-1]] >= RANK[low]:
                out.append(held.pop())
            held.append(low)
            operand = False
        elif token == "(":
            if operand:
                raise ValueError(expression)
            held.append(token)
        elif token == ")":
            if not operand:
                raise ValueError(expression)
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                raise ValueError(expression)
            held.pop()
        else:
            if operand:
                break  # prose after the expression
            out.append(token)
            operand = True
    while held:
        if held[-1] == "(" or not operand:
            raise ValueError(expression)
        out.append(held.pop())
    return out


def evaluate(expression: str) -> tuple[set[str], bool]:
    """Labels of an expression, and whether its terms can all be met by permissive licences."""
    stack: list[tuple[set[str], bool, str | None]] = []  # labels, permissive, and the name where it is a single one
    try:
        for token in to_postfix(expression):
            if token.lower() in RANK:
                right, left = stack.pop(), stack.pop()
                if token == "with":
                    if right[2] is None or left[2] is None or not EXCEPTION.fullmatch(right[2]):
                        raise ValueError(expression)
                    stack.append((left[0], left[1], None))  # the exception widens what stands left; it is no licence itself
                else:
                    stack.append((left[0] | right[0], (left[1] or right[1]) if token == "or" else (left[1] and right[1]), None))
            else:
                label = label_of(token)
                stack.append(({label} if label else set(), label in PERMISSIVE, token))
    except ValueError:
        return {label for t in _TOKEN.findall(expression) if (label := label_of(t))}, False
    return stack[-1][:2] if stack else (set(), False)


@cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, permissive."""
    words = words_of(text)
    line = b" ".join([b"", *words, b""]).decode("utf-8", "surrogatepass")
    at, n, starts, base, labels, doubt, tagged = 0, 0, [], set(), set(), 1.0, False
    for end, phrase in _automaton().iter(line):
        start = end - len(phrase) - 1
        n += line.count(" ", at, start) if start >= at else -line.count(" ", start, at)
        at = start
        if phrase in BASE:
            starts.append(n)
            base.add(BASE[phrase])
            doubt *= 1 - BASE_WEIGHT
        if phrase in NOTICES:
            labels.add(NOTICES[phrase][0])
            doubt *= 1 - NOTICES[phrase][1]
        tagged |= phrase == TAG
    permissive = None
    if tagged:
        for m in _TAG.finditer(text):
            found, free = evaluate(m[1])
            if found:
                labels |= found
                doubt *= 1 - TAG_WEIGHT
                permissive = free if permissive is None else permissive and free
    labels |= base
    if permissive is None and labels:
        permissive = labels <= PERMISSIVE
    return (
        len(words), len(starts), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 - doubt, permissive,
    )


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.bool_()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [(i, *scan(t.as_py())) for i, t in zip(ids, batch.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(run, SCHEMA)


def op1_license_scans(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
