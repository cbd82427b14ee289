"""Office ingest of small files made here."""

import zipfile

from docketry.sources.office import read_docx, read_xlsx

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
P = "<w:p>{}<w:r><w:t>{}</w:t></w:r></w:p>"
HEAD = '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>'


def test_docx(spark, tmp_path):
    cells = "".join(f"<w:tr><w:tc>{P.format('', a)}</w:tc><w:tc>{P.format('', b)}</w:tc></w:tr>" for a, b in [("x", "y"), ("", "z")])
    body = P.format(HEAD, "第1条 付款") + P.format("", " ") + P.format("", "plain") + f"<w:tbl>{cells}</w:tbl>"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
    (tmp_path / "b.docx").write_bytes(b"not a zip file")
    rows = read_docx(spark, str(tmp_path)).orderBy("path", "pos").collect()
    got = [(r.pos, r.block_type, r.cell, r.text) for r in rows if r.error is None]
    assert got == [(0, "heading", None, "第1条 付款"), (1, "paragraph", None, "plain"), (2, "table_cell", "T1R1C1", "x"), (3, "table_cell", "T1R1C2", "y"), (4, "table_cell", "T1R2C2", "z")]
    assert [r.error for r in rows if r.error] == ["BadZipFile"] and len({r.document_id for r in rows}) == 2


def test_xlsx(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cells = '<c r="A1" t="s"><v>0</v></c><c r="B1"><v>5</v></c><c r="C1" t="b"><v>1</v></c><c r="D1"><f>A1+1</f></c><c r="E1" t="inlineStr"><is><t>in</t></is></c><c r="F1"/>'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>shared</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData><row>{cells}</row></sheetData></worksheet>")
    rows = read_xlsx(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.cell, r.text) for r in rows] == [("S1!A1", "shared"), ("S1!B1", "5"), ("S1!C1", "TRUE"), ("S1!D1", "=A1+1"), ("S1!E1", "in")]
