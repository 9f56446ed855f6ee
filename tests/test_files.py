"""Files in, reports out: workbooks, query packages, models, projects, the command line, arrivals."""

import base64
import io
import json
import struct
import zipfile

import pytest

from tabdrift import api, sinks
from tabdrift.__main__ import main
from tabdrift.functions import dax, documents, mquery
from tabdrift.operators import analysis, objects
from tabdrift.sources import mashup, workbook
from tabdrift.streaming import arrivals


def framed(expression):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("Formulas/Section1.m", f"section Section1;\nshared Q = {expression};\n")
    meta = b'<M><Items><Item><ItemLocation><ItemType>Formula</ItemType><ItemPath>Section1/Q</ItemPath></ItemLocation><E><Entry Type="FillEnabled" Value="l1"/></E></Item></Items></M>'
    parts = (inner.getvalue(), b"<P><FirewallEnabled>false</FirewallEnabled></P>", meta, b"")
    return struct.pack("<I", 0) + b"".join(struct.pack("<I", len(p)) + p for p in parts)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    for side, skip in (("a", -1), ("b", 12)):
        (root / side / "x").mkdir(parents=True)
        data = spark.createDataFrame([(i, f"n{i}", i * 1.5) for i in range(30) if i != skip], "id int, name string, v double").coalesce(1)
        sheets = {"Data": data, "Other": spark.createDataFrame([(1,)], "x int")}
        if side == "b":
            sheets["New"] = sheets["Other"]
        with open(root / side / "x" / "one.xlsx", "wb") as f:
            sinks.workbook(sheets, f)
        text = '<?xml version="1.0" encoding="utf-16"?><DataMashup>' + base64.b64encode(framed("let a = 1 in a" if side == "a" else "let a = 2 in a")).decode() + "</DataMashup>"
        with zipfile.ZipFile(root / side / "x" / "one.xlsx", "a") as z:
            z.writestr("customXml/item1.xml", text.encode("utf-16"))
    (root / "b" / "x" / "broken.xlsx").write_text("no")
    return str(root)


def test_workbooks(spark, folder, tmp_path, capsys):
    old, new = f"{folder}/a/x/one.xlsx", f"{folder}/b/x/one.xlsx"
    found = api.diff_workbooks(spark, old, new)
    assert sorted((r.kind, r.sheet or r.name) for r in found.ops.collect()) == [("QueryDefinitionChanged", "Section1/Q"), ("RowRemoved", "Data"), ("SheetAdded", "New")]
    assert found.complete() and found.outcome()["counts"]["op_count"] == 3
    text = list(found.text())
    assert "  - Row 14: REMOVED" in text and text[-1] == "  Status: complete" and "  Total changes: 3" in text
    assert "@@ Power Query @@" in list(found.git())
    out = io.StringIO()
    sinks.json_report(found.ops, found.warnings, out)
    assert len(json.loads(out.getvalue())["ops"]) == 3
    sinks.json_lines(found.ops, f"{tmp_path}/lines")
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/lines").collect()]
    assert {"kind": "Header", "version": "1", "strings": ["Data", "New", "Section1/Q"]} in lines and len(lines) == 4
    sinks.op_store(found.ops, f"{tmp_path}/store", "d1")
    assert spark.read.parquet(f"{tmp_path}/store").where("kind = 'RowRemoved'").select("row", "row_end").collect() == [(13, 13)]
    assert {k: v.count() for k, v in sinks.audit_tables(found.ops, found.warnings).items()}["Structure"] == 2
    rows, whole = sinks.collected(found.ops, 2)
    assert len(rows) == 2 and not whole
    seen = []
    assert sinks.for_each(found.ops, seen.append) == len(seen) == 3
    payload = found.payload()
    assert payload["rows"].where("kind = 'delete'").count() == 1 and payload["old"].where("of_interest").count() > 0
    with open(tmp_path / "audit.xlsx", "wb") as f:
        sinks.workbook(sinks.audit_tables(found.ops, found.warnings), f)
    assert {r["sheet"] for r in workbook.read((tmp_path / "audit.xlsx").read_bytes()) if r["kind"] == "sheet"} >= {"Summary", "Cells", "OtherOps"}
    assert main(["diff", old, new, "--database", "--keys", "A"], spark) == 1 and "- Row 14: REMOVED" in capsys.readouterr().out
    assert main(["diff", old, old], spark) == 0 and main(["diff", old, new, "--keys", "A"], spark) == 2 and main(["diff", "/nowhere.xlsx", new], spark) == 2
    assert main(["info", old], spark) == 0 and "query\tSection1/Q\tsheet" in capsys.readouterr().out


def test_batch_and_arrivals(spark, folder, tmp_path):
    found, status = api.diff_batch(spark, f"{folder}/a", f"{folder}/b")
    assert {(r.path, r.status, r.op_count) for r in status.collect()} == {("x/one.xlsx", "done", 2), ("x/broken.xlsx", "missing_old", 0)}
    query = arrivals.follow(spark, f"{folder}/b", f"{folder}/a", f"{tmp_path}/store", f"{tmp_path}/checkpoint")
    query.awaitTermination()
    assert {r.kind for r in spark.read.parquet(f"{tmp_path}/store").collect()} == {"RowRemoved", "SheetAdded"}


def test_packages():
    got = list(mashup.read_package(framed("1")))
    assert [(r["kind"], r.get("member")) for r in got] == [("member", "Q"), ("metadata", "Q"), ("permissions", None)]
    assert got[1]["load_to_sheet"] and not got[2]["firewall"]
    for bad in (b"", b"\1\0\0\0", framed("1")[:-1], framed("1") + b"x"):
        with pytest.raises(mashup.Broken):
            mashup.frame(bad)
    model = {"model": {"tables": [{"name": "T", "columns": [{"name": "c", "dataType": "int64"}], "measures": [{"name": "m", "expression": ["a", "b"]}]}], "relationships": [{"fromTable": "T", "fromColumn": "c", "toTable": "U", "toColumn": "d"}]}}
    kinds = {r["kind"]: r for r in mashup.read_model(json.dumps(model))}
    assert kinds["measure"]["name"] == "T/m" and kinds["measure"]["expression"] == "a\nb" and kinds["relationship"]["to_table"] == "U"
    assert [r["name"] for r in mashup.read_model('{"x": {"name": "N", "y": {"measures": [{"name": "m", "expression": "1"}]}}}')] == ["N/m"]
    assert workbook.typed(None, "1_000", []) == ("text", None, "1_000", None) and workbook.typed("s", "", []) == ("text", None, "", None)
    assert workbook.typed(None, " 1.5e3 ", [])[1] == 1500.0 and workbook.typed("e", " #N/A ", [])[2] == "#N/A"


def test_scripts():
    a = 'let Source = f("x"), #"B b" = Table.SelectRows(Source, each [A] > 5), C = Table.RenameColumns(#"B b", {{"p", "q"}}) in C'
    assert [(s["name"], s["kind"], s["refs"]) for s in mquery.steps(a)] == [("Source", "Other", []), ("B b", "TableSelectRows", ["Source"]), ("C", "TableRenameColumns", ["B b"])]
    assert mquery.steps(a)[2]["detail"] == {"renames": [{"from": "p", "to": "q"}]}
    assert mquery.definition_change(a, a.replace(" in C", "\n// end\nin C"))["kind"] == "FormattingOnly"
    changed = mquery.definition_change(a, a.replace("> 5", "> 6"))
    assert changed["kind"] == "Semantic" and [s["name"] for s in json.loads(changed["detail"])["steps"]] == ["B b"]
    assert mquery.definition_change("[a=1, b=2]", "[b = 2, a = 1]", suppress=True) is None
    assert mquery.edit_summary("{1,2}", "{2,1}")["mode"] == "ordered" and mquery.parse("let x = in")[0] == "opaque"
    assert mquery.members('section S;\nshared A = let x = "a;b" in x; // c\nshared #"B q" = 1;') == [("S", "A", 'let x = "a;b" in x'), ("S", "B q", "1")]
    for bad in ("shared A = 1;", "section S; shared = 1;", "section S; shared A = 1"):
        with pytest.raises(mquery.BadSection):
            mquery.members(bad)
    same = [("SUM ( S[A] )", "sum(s[a])"), ("VAR x = 1 RETURN x + 1 -- c", "var x=1 return (x+1)"), ("'D'[Y] = 2", "d[y]=2")]
    assert all(dax.semantic_hash(x) == dax.semantic_hash(y) is not None for x, y in same)
    assert dax.semantic_hash("1+2*3") != dax.semantic_hash("(1+2)*3") and dax.semantic_hash("SUM(") is None


def test_projects(spark, tmp_path, capsys):
    guid = "01234567-89ab-cdef-0123-456789abcdef"
    old = {"r.json": f'{{"id": "{guid}", "pages": [{{"name": "p"}}, {{"name": "q", "x": 1}}]}}', "m.tmdl": "table T\r\n  measure m = 1\n  column c\n", "target/x.json": "{}", "gone.txt": "x"}
    new = {"r.json": f'{{"pages": [{{"name": "p"}}, {{"x": 2, "name": "q"}}], "id": "{guid[::-1][:8]}{guid[8:]}"}}', "m.tmdl": "table T\n  measure m = 2\n  column c\n", "bad.json": "{"}
    for name, files in (("a", old), ("b", new)):
        for path, text in files.items():
            (tmp_path / name / path).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / name / path).write_bytes(text.encode())
    found = api.diff_projects(spark, f"{tmp_path}/a", f"{tmp_path}/b")
    assert {(r.path, r.change) for r in found.documents.collect()} == {("r.json", "modified"), ("m.tmdl", "modified"), ("gone.txt", "removed"), ("bad.json", "added")}
    assert {(r.kind, r.label, r.change) for r in found.entities.collect()} == {("page", "q", "modified"), ("table", "T", "modified"), ("measure", "T.m = 1", "removed"), ("measure", "T.m = 2", "added")}
    assert any("## m.tmdl: modified (Model)" == line for line in found.markdown())
    assert documents.canonical_json(f'{{"b": "{guid}", "aId": "{guid}"}}') == '{\n  "aId": "GUID_0001",\n  "b": "' + guid + '"\n}\n'
    assert main(["project", "diff", f"{tmp_path}/a", f"{tmp_path}/a"], spark) == 0


def test_objects(spark):
    names = spark.createDataFrame([("p", "old", "A", "x", 0), ("p", "old", "a", "y", 1), ("p", "new", "A", "y", 0), ("p", "new", "B", "q", 1)], "pair_id string, side string, name string, refers_to string, position int")
    assert [(r.kind, r.name) for r in objects.named_ranges(names).collect()] == [("NamedRangeAdded", "B")]
    counts = analysis.change_counts(objects.named_ranges(names)).first()
    assert (counts.op_count, counts.added, counts.medium) == (1, 1, 1)
    assert objects.named_ranges(names.where("false")).count() == 0
