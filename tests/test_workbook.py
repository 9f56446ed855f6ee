"""Workbooks written here, read back."""

import zipfile

from tabdrift.sources import workbook

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def write(path, rows):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f"""<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets><sheet name="My Data" sheetId="7" r:id="rId1"/></sheets>
          <definedNames><definedName name="Total" localSheetId="0">'My Data'!$A$1</definedName><definedName name="All">'My Data'!$A$1:$B$2</definedName></definedNames></workbook>""")
        z.writestr("xl/_rels/workbook.xml.rels", f"""<Relationships><Relationship Id="rId1" Type="{REL}/worksheet" Target="worksheets/first.xml"/></Relationships>""")
        z.writestr("xl/sharedStrings.xml", f"""<sst xmlns="{MAIN}"><si><t>plain</t></si><si><r><t>rich </t></r><r><t>text</t></r></si></sst>""")
        z.writestr("xl/worksheets/first.xml", f"""<worksheet xmlns="{MAIN}"><sheetData>{rows}</sheetData></worksheet>""")


def test_scan(spark, tmp_path):
    write(tmp_path / "a.xlsx", """<row r="1"><c r="A1" t="s"><v>1</v></c><c r="C1"><f>A1+1</f><v>2.5</v></c></row>
      <row r="3"><c r="A3" t="b"><v>1</v></c><c t="b"><v>x</v></c><c r="C3"><v></v></c><c r="D3"><v>1,5</v></c><c r="E3" t="e"><v>#N/A</v></c><c r="F3" t="inlineStr"><is><t>in</t></is></c></row>""")
    (tmp_path / "b.xlsx").write_bytes(b"no package")
    write(tmp_path / "c.xlsx", """<row r="1"><c r="A1" t="s"><v>9</v></c></row>""")
    records = workbook.scan(spark, str(tmp_path)).cache()
    of = lambda df, *c: sorted([tuple(r) for r in df.where("path like '%a.xlsx'").select(*c).collect()], key=repr)
    assert of(workbook.cells(records), "row", "col", "vkind", "num", "txt", "flag", "formula") == sorted([
        (0, 0, "text", None, "rich text", None, None), (0, 2, "number", 2.5, None, None, "A1+1"), (2, 0, "bool", None, None, True, None),
        (2, 2, "text", None, "", None, None), (2, 3, "text", None, "1,5", None, None), (2, 4, "error", None, "#N/A", None, None), (2, 5, "text", None, "in", None, None),
    ], key=repr)
    assert of(workbook.sheets(records), "sheet", "sheet_id", "n_rows", "n_cols", "n_cells") == [("My Data", 7, 3, 6, 7)]
    assert of(workbook.names(records), "name", "sheet") == [("'My Data'!Total", "My Data"), ("All", None)]
    assert records.where("kind = 'error' and txt = 'not a package' and path like '%b.xlsx'").count() == 1
    assert records.where("kind = 'error' and txt like 'shared string%' and path like '%c.xlsx'").count() == 1


def test_limits(tmp_path):
    write(tmp_path / "a.xlsx", "")
    data = (tmp_path / "a.xlsx").read_bytes()
    for limits in (workbook.Limits(entries=2), workbook.Limits(part_bytes=10), workbook.Limits(total_bytes=50)):
        try:
            list(workbook.read(data, limits))
            raise AssertionError("read")
        except workbook.Broken:
            pass
