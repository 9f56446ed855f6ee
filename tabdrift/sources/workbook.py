"""Workbooks (zipped XML packages) as tables of sheets, cells, defined names, charts and part fingerprints.

Executors parse whole files, one at a time, twice: once to see that all of it can be read, then to stream the cells out
in batches, so memory doesn't grow with a sheet; nothing is gathered at the driver. A file that breaks a limit or can't be
read gives one row of kind "error", and nothing else, instead of failing the job."""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "path string, kind string, sheet string, sheet_id long, position int, row long, col int, vkind string, num double, txt string, flag boolean, "
    "formula string, name string, refers_to string, chart_type string, hash string, size long"
)
_NUMBER = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?(inf|infinity|nan)", re.I)
_PLACE = re.compile(r"\$?([A-Za-z]{1,3})\$?([0-9]+)$")
#: Fixed: a sheet's name with one of these is quoted in front of a name.
_QUOTED = set(" '!,;[]()")


@dataclass(frozen=True)
class Limits:
    entries: int = 10_000
    part_bytes: int = 100 << 20
    total_bytes: int = 500 << 20


class Broken(ValueError):
    """The file can't be read; the text says why."""


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def place(address: str) -> tuple[int, int] | None:
    """Zero-based (row, col) of an address such as B7."""
    m = _PLACE.match(address or "")
    if not m or m[2] == "0":
        return None
    col = 0
    for c in m[1].upper():
        col = col * 26 + ord(c) - 64
    return int(m[2]) - 1, col - 1


def typed(kind: str | None, raw: str | None, strings: list[str]) -> tuple[str | None, float | None, str | None, bool | None]:
    """(vkind, num, txt, flag) of a stored value; a number that can't be read is text, a bad truth value is none, and an
    empty value of any kind is an empty text."""
    if raw is None:
        return None, None, None, None
    value = raw.strip()
    if kind in ("str", "inlineStr"):
        return "text", None, raw, None
    if value == "":
        return "text", None, "", None
    if kind == "s":
        at = int(value) if value.isascii() and value.isdigit() else -1
        if not 0 <= at < len(strings):
            raise Broken(f"shared string {raw!r} is missing")
        return "text", None, strings[at], None
    if kind == "b":
        flag = {"1": True, "0": False}.get(value)
        return (None,) * 4 if flag is None else ("bool", None, None, flag)
    if kind == "e":
        return "error", None, value, None
    return ("number", float(value), None, None) if _NUMBER.fullmatch(value) else ("text", None, value, None)


class Package:
    def __init__(self, data: bytes, limits: Limits = Limits()):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as e:
            raise Broken("not a package") from e
        infos = self.zip.infolist()
        if len(infos) > limits.entries:
            raise Broken(f"more than {limits.entries} parts")
        if sum(i.file_size for i in infos) > limits.total_bytes:
            raise Broken(f"more than {limits.total_bytes} bytes")
        large = next((i.filename for i in infos if i.file_size > limits.part_bytes), None)
        if large:
            raise Broken(f"{large} has more than {limits.part_bytes} bytes")
        self.infos = {i.filename: i for i in infos}
        if "xl/workbook.xml" not in self.infos:
            raise Broken("binary workbooks aren't supported" if "xl/workbook.bin" in self.infos else "no workbook part")

    def xml(self, part: str) -> ElementTree.Element | None:
        if part not in self.infos:
            return None
        try:
            return ElementTree.fromstring(self.zip.read(part))
        except ElementTree.ParseError as e:
            raise Broken(f"{part}: {e}") from e

    def links(self, part: str) -> dict[str, tuple[str, str]]:
        """Relationship id to (type, target part)."""
        folder, name = posixpath.split(part)
        root = self.xml(f"{folder}/_rels/{name}.rels")
        out = {}
        for r in root if root is not None else ():
            target = r.get("Target", "")
            full = target[1:] if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
            out[r.get("Id", "")] = (r.get("Type", "").rsplit("/", 1)[-1], full)
        return out

    def strings(self) -> list[str]:
        root = self.xml("xl/sharedStrings.xml")
        return [] if root is None else [plain(item) for item in root if local(item.tag) == "si"]

    def cells(self, part: str, strings: list[str]) -> Iterator[dict]:
        if part not in self.infos:
            raise Broken(f"{part} is missing")
        row = -1
        rows = None
        with self.zip.open(part) as f:
            try:
                for event, e in ElementTree.iterparse(f, ("start", "end")):
                    tag = local(e.tag)
                    if event == "start":
                        if tag == "sheetData":
                            rows = e
                        elif tag == "row":
                            row, col = int(e.get("r", row + 2)) - 1, -1
                        continue
                    if tag == "c":
                        at = place(e.get("r", "")) or (row, col + 1)
                        col = at[1]
                        kind, raw, formula = e.get("t"), None, None
                        for x in e:
                            if local(x.tag) == "v":
                                raw = x.text or ""
                            elif local(x.tag) == "is":
                                raw = plain(x)
                            elif local(x.tag) == "f":
                                formula = x.text or None
                        vkind, num, txt, flag = typed(kind, raw, strings)
                        if vkind or formula:
                            yield {"row": at[0], "col": at[1], "vkind": vkind, "num": num, "txt": txt, "flag": flag, "formula": formula}
                    elif tag == "row" and rows is not None:
                        rows.clear()  # cells that were read need no memory
            except ElementTree.ParseError as e:
                raise Broken(f"{part}: {e}") from e


def plain(item: ElementTree.Element) -> str:
    """The text of a string item: all its runs, without phonetic hints."""
    out = []
    for x in item:
        if local(x.tag) == "t":
            out.append(x.text or "")
        elif local(x.tag) == "r":
            out += [t.text or "" for t in x if local(t.tag) == "t"]
    return "".join(out)


def scoped(sheet: str, name: str) -> str:
    """The full name of a name that belongs to a sheet."""
    return "'" + sheet.replace("'", "''") + f"'!{name}" if _QUOTED & set(sheet) else f"{sheet}!{name}"


def read(data: bytes, limits: Limits = Limits()) -> Iterator[dict]:
    """Records of one workbook."""
    package = Package(data, limits)
    for info in package.infos.values():
        yield {"kind": "part", "name": info.filename, "hash": f"{info.CRC:08x}", "size": info.file_size}
    book, links, strings = package.xml("xl/workbook.xml"), package.links("xl/workbook.xml"), package.strings()
    sheets = []
    for e in book.iter():
        if local(e.tag) == "sheet":
            rel = next((v for k, v in e.attrib.items() if local(k) == "id"), "")
            sheets.append((e.get("name", ""), int(e.get("sheetId", 0)), links.get(rel, ("", f"xl/worksheets/sheet{e.get('sheetId')}.xml"))[1]))
    for position, (name, number, part) in enumerate(sheets):
        here = {"sheet": name, "sheet_id": number, "position": position}
        yield {"kind": "sheet", "name": part, **here}
        for cell in package.cells(part, strings):
            yield {"kind": "cell", **here, **cell}
        for kind, drawing in package.links(part).values():
            if kind != "drawing":
                continue
            for what, chart in package.links(drawing).values():
                if what == "chart" and chart in package.infos:
                    yield {"kind": "chart", **here, **chart_of(chart, package.zip.read(chart))}
    for e in book.iter():
        if local(e.tag) == "definedName":
            at, name = e.get("localSheetId"), e.get("name", "")
            owner = sheets[int(at)][0] if at is not None and at.isdigit() and int(at) < len(sheets) else None
            yield {"kind": "name", "sheet": owner, "name": scoped(owner, name) if owner is not None else name, "refers_to": e.text or ""}


def chart_of(part: str, data: bytes) -> dict:
    root = ElementTree.fromstring(data)
    tags = [local(e.tag) for e in root.iter()]
    source = next((e.text for e in root.iter() if local(e.tag) == "f"), None)
    return {
        "name": posixpath.splitext(posixpath.basename(part))[0], "chart_type": next((t for t in tags if t.endswith("Chart")), None),
        "refers_to": source, "hash": hashlib.md5(data).hexdigest(), "size": len(data),
    }


def records(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """All records of files(path, content), kind telling them apart: part, sheet, cell, chart, name, error."""

    def run(batches):
        import pyarrow as pa

        kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
        schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in SCHEMA.split(", "))])
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    for _ in read(data.as_py(), limits):  # a file that breaks late must not give half a workbook
                        pass
                except (Broken, ElementTree.ParseError, zipfile.BadZipFile, ValueError) as e:
                    yield pa.RecordBatch.from_pylist([{"path": path, "kind": "error", "txt": str(e)}], schema)
                    continue
                held: list[dict] = []
                for record in read(data.as_py(), limits):
                    held.append({"path": path, **record})
                    if len(held) == 10_000:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def scan(spark: SparkSession, root: str, glob: str = "*.xls[xm]", limits: Limits = Limits()) -> DataFrame:
    """Records of the workbooks at a path or under a folder."""
    return records(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root), limits)


def cells(found: DataFrame) -> DataFrame:
    return found.where("kind = 'cell'").select("path", "sheet", "row", "col", "vkind", "num", "txt", "flag", "formula")


def sheets(found: DataFrame) -> DataFrame:
    """Sheets with their bounding box."""
    box = found.where("kind in ('sheet', 'cell')").groupBy("path", "sheet", "sheet_id", "position")
    return box.agg((F.coalesce(F.max("row"), F.lit(-1)) + 1).alias("n_rows"), (F.coalesce(F.max("col"), F.lit(-1)) + 1).alias("n_cols"), F.count("row").alias("n_cells"))


def names(found: DataFrame) -> DataFrame:
    return found.where("kind = 'name'").select("path", "name", "sheet", "refers_to")


def charts(found: DataFrame) -> DataFrame:
    return found.where("kind = 'chart'").select("path", "sheet", "sheet_id", "name", "chart_type", "refers_to", "hash")


def fingerprints(found: DataFrame) -> DataFrame:
    """(path, sheet, print): checksum and size of each sheet's part and of the shared strings. Sheets with equal prints
    have equal cells."""
    parts = found.where("kind = 'part'").select("path", F.col("name").alias("part"), F.concat_ws(":", "hash", "size").alias("print"))
    strings = parts.where("part = 'xl/sharedStrings.xml'").select("path", F.col("print").alias("strings"))
    one = found.where("kind = 'sheet'").select("path", "sheet", F.col("name").alias("part")).join(parts, ["path", "part"]).join(strings, "path", "left")
    return one.select("path", "sheet", F.concat_ws("/", "print", "strings").alias("print"))
