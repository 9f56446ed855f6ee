"""Normal forms and parts of project documents: JSON reports and indented model text."""

from __future__ import annotations

import json
import re

from .batch import batched

PROFILES = ("strict", "balanced", "aggressive")
_GUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")


def plain_text(raw: str) -> str:
    """LF line ends, no blanks at line ends, a line end at the end."""
    lines = [line.rstrip(" \t") for line in raw.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    out = "\n".join(lines)
    return out if out.endswith("\n") else out + "\n"


def _names_an_id(key: str | None) -> bool:
    key = (key or "").strip()
    return key.lower() in ("id", "guid", "objectid") or key.endswith(("Id", "ID")) or "guid" in key.lower()


def canonical_json(raw: str, profile: str = "balanced") -> str:
    """Sorted keys, two blanks to indent; GUIDs become numbered placeholders, by order of appearance: those under keys
    that name an id (balanced), or all (aggressive)."""
    known: dict[str, str] = {}

    def walk(value, key):
        if isinstance(value, dict):
            return {k: walk(value[k], k) for k in sorted(value)}
        if isinstance(value, list):
            return [walk(v, key) for v in value]
        if isinstance(value, str) and _GUID.fullmatch(value) and (profile == "aggressive" or profile == "balanced" and _names_an_id(key)):
            return known.setdefault(value, f"GUID_{len(known) + 1:04d}")
        return value

    return json.dumps(walk(json.loads(raw), None), indent=2, ensure_ascii=False) + "\n"


def kind_of(path: str) -> str:
    low = path.lower()
    return "pbir" if low.endswith((".pbir", ".json", ".platform")) else "tmdl" if low.endswith(".tmdl") else "other"


def normalized(path: str, raw: str | None, profile: str = "balanced") -> dict:
    """kind, text (normal form) and error of a document."""
    kind = kind_of(path)
    if raw is None:
        return {"kind": kind, "text": None, "error": "not read"}
    try:
        return {"kind": kind, "text": canonical_json(raw, profile) if kind == "pbir" and profile != "strict" else plain_text(raw), "error": None}
    except (ValueError, RecursionError) as e:
        return {"kind": kind, "text": plain_text(raw), "error": f"JSON: {e}"}


_LISTS = (("pages", "page", ("displayName", "name")), ("visuals", "visual", ("title", "name", "id")), ("bookmarks", "bookmark", ("displayName", "name")))


def json_entities(text: str) -> list[dict]:
    """Pages, visuals, bookmarks and the theme of a report."""
    try:
        root = json.loads(text)
    except ValueError:
        return []
    if not isinstance(root, dict):
        return []
    pretty = lambda v: json.dumps(v, indent=2, ensure_ascii=False) + "\n"
    label = lambda v, keys, other: next((v[k] for k in keys if isinstance(v, dict) and isinstance(v.get(k), str)), other)
    out = []
    for field, kind, keys in _LISTS:
        if isinstance(root.get(field), list):
            out += [{"kind": kind, "label": label(v, keys, kind), "pointer": f"/{field}/{i}", "text": pretty(v)} for i, v in enumerate(root[field])]
    if root.get("theme") is not None:
        out.append({"kind": "theme", "label": label(root["theme"], ("name",), "theme"), "pointer": "/theme", "text": pretty(root["theme"])})
    return out


_BLOCK = re.compile(r"([ \t]*)(table|measure|column|relationship) +(\S.*?)\s*$")


def text_entities(text: str) -> list[dict]:
    """Table, measure, column and relationship blocks of model text; a block ends where the indent returns. Measures and
    columns carry their table's name, and nothing inside a block but a table's starts another one."""
    lines = text.split("\n")
    indent = lambda s: len(s) - len(s.lstrip())
    out: list[dict] = []
    table, depth, at = None, 0, 0
    while at < len(lines):
        line = lines[at]
        if line.strip() and table is not None and indent(line) <= depth and not line.lstrip().startswith("table "):
            table = None
        m = _BLOCK.match(line)
        if not m:
            at += 1
            continue
        end = at + 1
        while end < len(lines) and (not lines[end].strip() or indent(lines[end]) > len(m[1])):
            end += 1
        name = m[3]
        if m[2] == "table":
            table, depth = name, len(m[1])
        label = f"{table}.{name}" if m[2] in ("measure", "column") and table is not None else name
        out.append({"kind": m[2], "label": label, "pointer": f"{m[2]}:{name}", "text": "\n".join(lines[at:end]).rstrip("\n") + "\n"})
        at = at + 1 if m[2] == "table" else end
    return out


def entities(kind: str | None, text: str | None) -> list[dict]:
    """Parts of a document, the first of each kind and label."""
    found = json_entities(text) if kind == "pbir" and text else text_entities(text) if kind == "tmdl" and text else []
    first: dict = {}
    for e in found:
        first.setdefault((e["kind"], e["label"]), e)
    return list(first.values())


def normal_form(profile: str):
    if profile not in PROFILES:
        raise ValueError(f"profile must be one of {PROFILES}")
    return batched(lambda path, raw: normalized(path, raw, profile), "struct<kind:string,text:string,error:string>")


def parts_of():
    return batched(entities, "array<struct<kind:string,label:string,pointer:string,text:string>>")
