"""Query packages inside workbooks and BI packages, and tabular models, as tables.

A query package is framed bytes in base64: version, then package parts, permissions, metadata and bindings, each with its
length. Executors read whole files, one at a time; a file that can't be read gives one row of kind error."""

from __future__ import annotations

import base64
import io
import json
import struct
import urllib.parse
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession

from ..functions import mquery
from .workbook import Broken, Limits, local

SCHEMA = (
    "path string, kind string, section string, member string, expression string, position int, load_to_sheet boolean, load_to_model boolean, group_path string, "
    "embedded string, name string, tbl string, data_type string, is_hidden boolean, format_string string, sort_by string, summarize_by string, from_table string, "
    "from_column string, to_table string, to_column string, cross_filtering_behavior string, cardinality string, is_active boolean, firewall boolean, future_packages boolean, group_type string, txt string"
)


def frame(data: bytes) -> tuple[bytes, bytes, bytes, bytes]:
    """Package parts, permissions, metadata, bindings. Version 0 only, and nothing after the last segment."""
    if len(data) < 4 or struct.unpack_from("<I", data)[0] != 0:
        raise Broken("not a query package of version 0")
    at, out = 4, []
    for _ in range(4):
        if at + 4 > len(data):
            raise Broken("a segment is missing")
        (size,) = struct.unpack_from("<I", data, at)
        if at + 4 + size > len(data):
            raise Broken("a segment ends early")
        out.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    if at != len(data):
        raise Broken("bytes after the last segment")
    return tuple(out)


def text_of(data: bytes) -> str:
    """XML text in UTF-8 or UTF-16, with or without a byte order mark."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16")
    if data[:3] == b"\xef\xbb\xbf":
        return data[3:].decode("utf-8")
    if data[:2] == b"<\x00":
        return data.decode("utf-16-le")
    if data[:2] == b"\x00<":
        return data.decode("utf-16-be")
    return data.decode("utf-8")


def _xml(text: str) -> ElementTree.Element:
    try:
        # the declared encoding is that of the bytes, not of the text
        return ElementTree.fromstring(text.split("?>", 1)[1] if text.lstrip().startswith("<?xml") else text)
    except (ElementTree.ParseError, IndexError) as e:
        raise Broken(f"XML: {e}") from e


def embedded(package: zipfile.ZipFile) -> bytes | None:
    """The framed bytes of a workbook's custom XML parts; more than one query package is an error."""
    found = []
    for name in package.namelist():
        if name.lower().startswith("customxml/item") and name.lower().endswith(".xml"):
            raw = package.read(name)
            if b"DataMashup" not in raw.replace(b"\x00", b""):
                continue
            for e in _xml(text_of(raw)).iter():
                if local(e.tag) == "DataMashup":
                    found.append("".join((e.text or "").split()))
    if len(found) > 1:
        raise Broken("more than one query package")
    if not found:
        return None
    try:
        return base64.b64decode(found[0], validate=True)
    except ValueError as e:
        raise Broken(f"base64: {e}") from e


def sections(parts: bytes, limits: Limits = Limits()) -> Iterator[tuple[str | None, str]]:
    """(name of the embedded package or None, section document) of the inner package."""
    try:
        inner = zipfile.ZipFile(io.BytesIO(parts))
    except zipfile.BadZipFile as e:
        raise Broken("the query package isn't zipped") from e
    infos = inner.infolist()
    if len(infos) > limits.entries or sum(i.file_size for i in infos) > limits.total_bytes or any(i.file_size > limits.part_bytes for i in infos):
        raise Broken("the query package is larger than allowed")
    names = {i.filename.lstrip("/"): i.filename for i in infos}
    if "Formulas/Section1.m" not in names:
        raise Broken("no section document")
    yield None, inner.read(names["Formulas/Section1.m"]).decode("utf-8-sig")
    for short, name in names.items():
        if short.startswith("Content/") and short != "Content/":
            try:
                content = zipfile.ZipFile(io.BytesIO(inner.read(name)))
                if "Formulas/Section1.m" in content.namelist():
                    yield short, content.read("Formulas/Section1.m").decode("utf-8-sig")
            except zipfile.BadZipFile:
                continue


_TRUTH = {"1": True, "true": True, "yes": True, "0": False, "false": False, "no": False}


def truth(text: str) -> bool | None:
    """A truth value, with or without the letter that marks its type."""
    low = text.strip().lower()
    return _TRUTH.get(low, _TRUTH.get(low[1:]) if low[:1] == "l" else None)


def _flag(entries: list[tuple[str, str]], *names: str) -> bool:
    return next((t for n, v in entries if n.lower() in map(str.lower, names) and (t := truth(v)) is not None), False)


def metadata(data: bytes) -> Iterator[dict]:
    """Load settings of formulas. Values carry a letter for their type in front."""
    start = data.find(b"<")
    if not data or start < 0:
        return
    end = data.rfind(b">")
    for item in _xml(text_of(data[start : end + 1] if data[start : start + 2] != b"<\x00" else data[start:])).iter():
        if local(item.tag) != "Item":
            continue
        kind = path = None
        entries: list[tuple[str, str]] = []
        for e in item.iter():
            tag = local(e.tag)
            if tag == "ItemType":
                kind = (e.text or "").strip()
            elif tag == "ItemPath":
                path = (e.text or "").strip()
            elif tag == "Entry" and e.get("Type"):
                entries.append((e.get("Type"), e.get("Value") or ""))
        if kind != "Formula":
            continue
        if not path:
            raise Broken("a formula has no path")
        section, _, member = urllib.parse.unquote(path).partition("/")
        group = next((v.strip() for n, v in entries if n.lower() in ("querygroupid", "querygrouppath", "querygroup")), "")
        yield {
            "kind": "metadata", "section": section, "member": member, "load_to_sheet": _flag(entries, "FillEnabled", "LoadEnabled"),
            "load_to_model": _flag(entries, "FillToDataModelEnabled", "AddedToDataModel", "LoadToDataModel"), "group_path": (group[1:] if group[:1] in ("s", "S") else group) or None,
        }


def permissions(data: bytes) -> dict:
    """Firewall flag and group type; defaults wherever they can't be read. Bindings can't be verified here."""
    out = {"kind": "permissions", "firewall": True, "future_packages": False, "group_type": None, "txt": "bindings unverified"}
    try:
        for e in _xml(text_of(data)).iter():
            tag = local(e.tag)
            if tag == "FirewallEnabled":
                out["firewall"] = t if (t := truth(e.text or "")) is not None else out["firewall"]
            elif tag == "CanEvaluateFuturePackages":
                out["future_packages"] = bool(truth(e.text or ""))
            elif tag == "WorkbookGroupType":
                out["group_type"] = (e.text or "").strip() or None
    except (Broken, UnicodeDecodeError):
        pass
    return out


def read_package(data: bytes, limits: Limits = Limits()) -> Iterator[dict]:
    """Members, load settings and permissions of framed bytes."""
    parts, rights, meta, _ = frame(data)
    for inner, text in sections(parts, limits):
        for position, (section, member, expression) in enumerate(mquery.members(text)):
            yield {"kind": "member", "section": section, "member": member, "expression": expression, "position": position, "embedded": inner}
    yield from metadata(meta)
    yield permissions(rights)


def _listed(value) -> list:
    return [v for v in value if isinstance(v, dict)] if isinstance(value, list) else []


def _expression(value) -> str | None:
    return "\n".join(map(str, value)) if isinstance(value, list) else value if isinstance(value, str) else None


def _measures(value, table: str = "") -> Iterator[tuple[str, dict]]:
    """Measures anywhere in a document that isn't laid out as a model, each with the nearest name around it."""
    if isinstance(value, dict):
        yield from ((table, m) for m in _listed(value.get("measures")))
        inner = value["name"] if isinstance(value.get("name"), str) else table
        for v in value.values():
            yield from _measures(v, inner)
    elif isinstance(value, list):
        for v in value:
            yield from _measures(v, table)


def read_model(text: str) -> Iterator[dict]:
    """Tables, columns, measures and relationships of a tabular model's JSON."""
    try:
        root = json.loads(text)
    except ValueError as e:
        raise Broken(f"model JSON: {e}") from e
    model = root.get("model", root) if isinstance(root, dict) else {}
    tables = _listed(model.get("tables"))
    found = []
    for position, t in enumerate(tables):
        yield {"kind": "table", "name": t.get("name", ""), "position": position}
        for k, c in enumerate(_listed(t.get("columns"))):
            yield {
                "kind": "column", "tbl": t.get("name", ""), "name": c.get("name", ""), "position": k, "data_type": c.get("dataType"), "is_hidden": c.get("isHidden"),
                "format_string": c.get("formatString"), "sort_by": c.get("sortByColumn"), "summarize_by": c.get("summarizeBy"), "expression": _expression(c.get("expression")),
            }
        found += [(t.get("name", ""), m) for m in _listed(t.get("measures"))]
    found += [("", m) for m in _listed(model.get("measures"))]
    if not tables:
        found = list(_measures(root))
    named = [(f"{t}/{m['name']}" if t else m["name"], m) for t, m in found if isinstance(m.get("name"), str)]
    for k, (name, m) in enumerate(named):
        yield {"kind": "measure", "name": name, "expression": _expression(m.get("expression")) or "", "position": k}
    for k, r in enumerate(_listed(model.get("relationships"))):
        yield {
            "kind": "relationship", "position": k, "from_table": r.get("fromTable", ""), "from_column": r.get("fromColumn", ""), "to_table": r.get("toTable", ""),
            "to_column": r.get("toColumn", ""), "cross_filtering_behavior": r.get("crossFilteringBehavior"), "cardinality": r.get("cardinality") or None, "is_active": r.get("isActive"),
        }


def read(data: bytes, limits: Limits = Limits()) -> Iterator[dict]:
    """Records of a workbook or BI package: its query package, its model, or an error where a BI package has neither."""
    try:
        package = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise Broken("not a package") from e
    names = set(package.namelist())
    if "DataMashup" in names:
        yield from read_package(package.read("DataMashup"), limits)
    elif (framed := embedded(package)) is not None:
        yield from read_package(framed, limits)
    model = next((n for n in ("DataModelSchema", "DataModel/model.json") if n in names), None)
    if model:
        yield from read_model(text_of(package.read(model)))
    elif "DataMashup" not in names and "xl/workbook.xml" not in names:
        raise Broken("neither queries nor a model")


def records(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """All records of files(path, content), kind telling them apart: member, metadata, permissions, table, column, measure,
    relationship, error."""

    def run(batches):
        import pyarrow as pa

        kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
        schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in SCHEMA.split(", "))])
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    rows = [{"path": path, **r} for r in read(data.as_py(), limits)]
                except (Broken, mquery.BadSection, UnicodeDecodeError, zipfile.BadZipFile) as e:
                    rows = [{"path": path, "kind": "error", "txt": str(e)}]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def scan(spark: SparkSession, root: str, glob: str = "*.{xlsx,xlsm,pbix,pbit}", limits: Limits = Limits()) -> DataFrame:
    """Records of the packages at a path or under a folder."""
    return records(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root), limits)
