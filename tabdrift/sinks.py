"""Writing operations: JSON lines, reports, a store, an audit workbook. Spark's commit makes each write whole or absent."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import analysis
from .schema import ORDER

VERSION = "1"
#: Rows that a sheet of a workbook can have.
SHEET_ROWS = 1_048_576


class NotFinite(ValueError):
    """A report can't hold NaN or infinite numbers."""


def plain(ops: DataFrame) -> DataFrame:
    """Operations as JSON texts (value) with the columns that order them; fields without a value are left out."""
    names = [c for c in ops.columns if c not in ORDER or c == "kind"]
    return ops.select(*ORDER[:-1], F.to_json(F.struct(*[F.col(f"`{c}`") for c in ["kind", *[n for n in names if n != "kind"]]])).alias("value"))


def json_lines(ops: DataFrame, path: str) -> None:
    """A header line with the names that operations use, then an operation per line in their order. Files follow each other
    in the order of their names."""
    names = ops.select(F.explode(F.array("sheet", "name", "name_to", "tbl")).alias("s")).where("s is not null").distinct()
    header = names.agg(F.array_sort(F.collect_set("s")).alias("strings")).select(F.to_json(F.struct(F.lit("Header").alias("kind"), F.lit(VERSION).alias("version"), "strings")).alias("value"))
    first = header.select(*[F.lit(None).alias(c) for c in ORDER[:-1]], "value")
    lines = first.unionByName(plain(ops))
    lines.orderBy(*[F.col(c).asc_nulls_first() for c in ORDER[:-1]], "value").select("value").write.mode("overwrite").text(path)


def for_each(ops: DataFrame, f: Callable, ordered: bool = True) -> int:
    """Calls f with every operation, in order at the driver, one partition in memory at a time; else on the executors in
    any order. Returns how many there were at the driver."""
    if not ordered:
        ops.foreachPartition(lambda rows: [f(r) for r in rows] and None)
        return -1
    n = 0
    for n, row in enumerate(ops.orderBy(*ORDER).toLocalIterator(), 1):
        f(row)
    return n


def collected(ops: DataFrame, most: int) -> tuple[list, bool]:
    """The first operations in order, and whether these are all; most bounds what the driver holds."""
    rows = ops.orderBy(*ORDER).limit(most + 1).collect()
    return rows[:most], len(rows) <= most


def check_finite(ops: DataFrame) -> None:
    bad = F.lit(False)
    for side in ("from", "to"):
        n = F.col(f"`{side}`")["num"]
        bad |= F.coalesce(F.isnan(n) | (F.abs(n) == float("inf")), F.lit(False))
    found = ops.where(bad).select("sheet", "row", "col").first()
    if found:
        raise NotFinite(f"{found['sheet']}: row {found['row']}, column {found['col']}")


def json_report(ops: DataFrame, warnings: DataFrame, out: io.TextIOBase) -> None:
    """The whole report as one JSON document, written as it is read."""
    check_finite(ops)
    told = sorted({r[0] for r in warnings.select("warning").toLocalIterator()})
    out.write(f'{{"version": "{VERSION}", "complete": {json.dumps(not told)}, "warnings": {json.dumps(told)}, "ops": [')
    for k, row in enumerate(plain(ops).orderBy(*ORDER[:-1], "value").toLocalIterator()):
        out.write(("," if k else "") + "\n" + row["value"])
    out.write("\n]}\n")


def op_store(ops: DataFrame, path: str, diff_id: str) -> None:
    """Operations as a table by diff and kind, with the columns that ranges are searched by and the whole as JSON."""
    stored = ops.select(
        F.lit(diff_id).alias("diff_id"), *ORDER[:-1], "kind", "sheet", "row", "col", "row_end", "col_end", analysis.move_id(F.col("kind")).alias("move_id"),
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in ops.columns])).alias("payload"),
    )
    stored.sortWithinPartitions("sheet", "row", "col").write.mode("append").partitionBy("diff_id", "kind").parquet(path)


# ---- text


def _line(r) -> list[str]:
    """An operation as lines that start with +, - or ~."""
    kind, name = r["kind"], r["name"] or ""
    row = lambda n: n + 1
    place = r["location"]
    if kind in ("SheetAdded", "SheetRemoved"):
        return [f'{"+" if kind == "SheetAdded" else "-"} Sheet "{r["sheet"]}": {kind[5:].upper()}']
    if kind == "SheetRenamed":
        return [f'~ Sheet renamed: "{name}" -> "{r["name_to"]}"']
    if kind in ("RowAdded", "RowRemoved", "RowReplaced"):
        return [f'{ {"RowAdded": "+", "RowRemoved": "-"}.get(kind, "~") } Row {row(r["row"])}: {kind[3:].upper()}']
    if kind in ("ColumnAdded", "ColumnRemoved"):
        return [f'{"+" if kind == "ColumnAdded" else "-"} Column {place.split(":")[0]}: {kind[6:].upper()}']
    if kind == "CellEdited":
        out = [f"~ Cell {place}:"] + ([f"- {r['before']}"] if r["before"] else []) + ([f"+ {r['after']}"] if r["after"] else [])
        return out if not r["formula_diff"] or r["formula_diff"] in ("Unchanged", "TextChange") else [*out, f"  ({r['formula_diff']})"]
    if kind.startswith("BlockMoved"):
        return [f"~ {kind[10:]} {place}: MOVED ({r['move_id']})"]
    if kind == "RectReplaced":
        return [f"~ Region {place}: REPLACED"]
    if kind == "DuplicateKeyCluster":
        return [f"~ Key {r['key']}: {len(r['left_rows'] or [])} old and {len(r['right_rows'] or [])} new rows"]
    sign = "+" if kind.endswith("Added") else "-" if kind.endswith("Removed") else "~"
    what = f'{r["tbl"]}.{name}' if r["tbl"] else name
    if kind == "QueryRenamed":
        return [f'~ Query renamed: "{name}" -> "{r["name_to"]}"']
    detail = f' {r["field"]}: {r["old"]} -> {r["new"]}' if r["field"] else f' ({r["change_kind"]})' if r["change_kind"] else f' {r["old"]} -> {r["new"]}' if r["old"] is not None and r["new"] is not None else ""
    return [f'{sign} {kind} "{what}"{detail}']


def _sections(ops: DataFrame) -> Iterator[tuple[str, str, object]]:
    """(section, sheet, operation) in the order of sections: workbook, sheets by name, queries, model."""
    k = F.col("kind")
    part = F.when(k.isin(*analysis.QUERIES), 2).when(k.isin(*analysis.MODEL), 3).when(F.col("sheet").isNotNull(), 1).otherwise(0)
    shown = ops.withColumns({
        "part": part, "before": analysis.rendered(F.col("from")), "after": analysis.rendered(F.col("to")), "location": analysis.location(k), "move_id": analysis.move_id(k),
    })
    titles = ("Workbook", "Sheet", "Power Query", "Model")
    for r in shown.orderBy("part", F.when(F.col("part") == 1, F.col("sheet")), *ORDER).toLocalIterator():
        yield titles[r["part"]], r["sheet"] if r["part"] == 1 else "", r


def _grouped(ops: DataFrame, title: Callable[[str, str], str], indent: str) -> Iterator[str]:
    at = None
    for section, sheet, r in _sections(ops):
        if (section, sheet) != at:
            at = (section, sheet)
            yield title(section, sheet)
        for line in _line(r):
            yield indent + line


def summary_lines(ops: DataFrame, complete: bool) -> list[str]:
    k = F.col("kind")
    groups = {
        "Sheet changes": k.startswith("Sheet"), "Row changes": k.isin("RowAdded", "RowRemoved", "RowReplaced", "DuplicateKeyCluster"),
        "Column changes": k.isin("ColumnAdded", "ColumnRemoved"), "Block moves": k.startswith("BlockMoved") | (k == "RectReplaced"),
        "Cell edits": k == "CellEdited", "Query changes": k.isin(*analysis.QUERIES), "Model changes": k.isin(*analysis.MODEL),
    }
    n = ops.agg(F.count("*").alias("Total changes"), *[F.count_if(c).alias(name) for name, c in groups.items()]).first().asDict()
    shown = [f"  {name}: {count}" for name, count in n.items() if count or name == "Total changes"]
    return ["---", "Summary:", *shown, "  Status: complete" if complete else "  Status: INCOMPLETE (some changes may be missing)"]


def text_report(ops: DataFrame, old: str, new: str, complete: bool = True, quiet: bool = False) -> Iterator[str]:
    """Lines of a report for people."""
    if not quiet:
        yield f"Comparing: {old.rsplit('/', 1)[-1]} -> {new.rsplit('/', 1)[-1]}"
        yield ""
        empty = True
        for line in _grouped(ops, lambda s, sheet: f'Sheet "{sheet}":' if s == "Sheet" else f"{s}:", "  "):
            empty = False
            yield line
        if empty:
            yield "No differences found."
    yield from summary_lines(ops, complete)


def git_diff(ops: DataFrame, old: str, new: str) -> Iterator[str]:
    """Lines in the manner of a version control tool."""
    yield from (f"diff --git a/{old} b/{new}", f"--- a/{old}", f"+++ b/{new}")
    empty = True
    for line in _grouped(ops, lambda s, sheet: f'@@ Sheet "{sheet}" @@' if s == "Sheet" else f"@@ {s} @@", ""):
        empty = False
        yield line
    if empty:
        yield "@@ No differences @@"


def project_markdown(docs: DataFrame, parts: DataFrame) -> Iterator[str]:
    """A project's diff: counts, documents, and the parts of each."""
    yield "# Project diff"
    yield ""
    yield "| kind | change | count |"
    yield "| --- | --- | --- |"
    for r in parts.select("kind", "change").unionByName(docs.select(F.lit("document").alias("kind"), "change")).groupBy("kind", "change").count().orderBy("kind", "change").collect():
        yield f"| {r['kind']} | {r['change']} | {r['count']} |"
    at = None
    both = docs.select("path", F.lit("").alias("kind"), F.lit("").alias("label"), "change", "impact").unionByName(parts.select("path", "kind", "label", "change", F.lit(None).cast("string").alias("impact")))
    for r in both.orderBy("path", "kind", "label").toLocalIterator():
        if r["path"] != at:
            at = r["path"]
            yield ""
        yield f"## {at}: {r['change']}" + (f" ({r['impact']})" if r["impact"] else "") if not r["kind"] else f"- {r['kind']} `{r['label']}`: {r['change']}"


# ---- audit workbook


def audit_tables(ops: DataFrame, warnings: DataFrame) -> dict[str, DataFrame]:
    """The sheets of an audit: Summary, Warnings, Cells, Structure, PowerQuery, Model, OtherOps."""
    k = F.col("kind")
    c = analysis.classified(ops).withColumn("place", analysis.location(k))
    rest = ["sheet", "kind", "place", "name", "name_to", "tbl", "field", "change_kind", "old", "new", "move_id", "severity"]
    cells = c.where("kind = 'CellEdited'").select("sheet", "place", analysis.rendered(F.col("from")).alias("old"), analysis.rendered(F.col("to")).alias("new"), F.col("from.formula").alias("old_formula"), F.col("to.formula").alias("new_formula"), "formula_diff")
    return {
        "Summary": c.groupBy("category", "severity", "change").agg(F.count("*").alias("count")),
        "Warnings": warnings.select("warning"),
        "Cells": cells,
        "Structure": c.where(k.isin(*[x for x in analysis.GRID if x != "CellEdited"])).select(*rest),
        "PowerQuery": c.where("category = 'PowerQuery'").select(*rest, "detail"),
        "Model": c.where("category = 'Model'").select(*rest),
        "OtherOps": c.where("category in ('Objects', 'Other')").select(*rest),
    }


def _sheet_xml(rows: Iterator) -> Iterator[bytes]:
    yield b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
    for row in rows:
        cells = []
        for v in row:
            if v is None:
                cells.append("<c/>")
            elif isinstance(v, bool):
                cells.append(f'<c t="b"><v>{int(v)}</v></c>')
            elif isinstance(v, (int, float)):
                cells.append(f"<c><v>{v!r}</v></c>")
            else:
                text = "".join(x for x in str(v) if x in "\t\n\r" or x >= " ")
                cells.append(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text[:32_767])}</t></is></c>')
        yield f"<row>{''.join(cells)}</row>".encode("utf-8", "replace")
    yield b"</sheetData></worksheet>"


def workbook(tables: dict[str, DataFrame], out: io.BufferedIOBase) -> None:
    """Tables as the sheets of a workbook, written as they are read; a sheet ends at the most rows that sheets can have."""
    names = list(tables)
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        links = "http://schemas.openxmlformats.org/package/2006/relationships"
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{links}"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        sheets = "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{rel}"><sheets>{sheets}</sheets></workbook>')
        each = "".join(f'<Relationship Id="rId{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{links}">{each}</Relationships>')
        for k, n in enumerate(names, 1):
            df = tables[n].limit(SHEET_ROWS - 1)
            with z.open(f"xl/worksheets/sheet{k}.xml", "w") as f:
                rows = iter([df.columns])
                for chunk in _sheet_xml(r for part in (rows, df.toLocalIterator()) for r in part):
                    f.write(chunk)
