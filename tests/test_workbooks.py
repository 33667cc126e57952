import datetime as dt
import zipfile
from xml.sax.saxutils import escape

from rowlens.sources.sheets import ingest
from rowlens.sources.workbooks import read_workbooks, workbook_cells

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def cell_xml(ref, value, shared):
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, dt.datetime):
        days = (value - dt.datetime(1899, 12, 30)) / dt.timedelta(days=1)
        return f'<c r="{ref}" s="1"><v>{days!r}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{ref}"><v>{value}</v></c>'
    if value.startswith("inline:"):
        return f'<c r="{ref}" t="inlineStr"><is><t>{escape(value[7:])}</t></is></c>'
    shared.append(value)
    return f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>'


def write_workbook(path, sheets):
    shared, parts = [], []
    for rows in sheets.values():
        lines = []
        for i, row in enumerate(rows, 1):
            cells = "".join(cell_xml(f"{chr(65 + j)}{i}", v, shared) for j, v in enumerate(row))
            lines.append(f'<row r="{i}">{cells}</row>')
        parts.append(f'<worksheet {NS}><sheetData>{"".join(lines)}</sheetData></worksheet>')
    with zipfile.ZipFile(path, "w") as book:
        names = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        book.writestr("xl/workbook.xml", f"<workbook {NS} {REL}><sheets>{names}</sheets></workbook>")
        links = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>',
        )
        book.writestr("xl/styles.xml", f'<styleSheet {NS}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        items = "".join(f"<si><t>{escape(s)}</t></si>" for s in shared)
        book.writestr("xl/sharedStrings.xml", f"<sst {NS}>{items}</sst>")
        for i, part in enumerate(parts, 1):
            book.writestr(f"xl/worksheets/sheet{i}.xml", part)


def test_folder_of_workbooks(spark, tmp_path):
    day = dt.datetime(2024, 1, 15, 6)
    write_workbook(
        tmp_path / "one.xlsx",
        {
            "Journals": [["Title of Publicaion", "Year", "Open", "Seen"], ["A & B", 2001, True, day], ["inline:C", None, False, None]],
            "Books": [["Title", "Price", "Mixed", "Title"], ["D", 2.5, 1, "E"], ["F", 3, "x", None]],
        },
    )
    write_workbook(tmp_path / "two.xlsx", {"Journals": [["Title of Publicaion", None, "Year"], ["G", 7, 2002]], "Empty": []})
    sheets = read_workbooks(spark, str(tmp_path))
    assert set(sheets) == {"Journals", "Books"}
    journals = sheets["Journals"]
    assert dict(journals.dtypes) == {"title": "string", "year": "bigint", "open": "boolean", "seen": "timestamp_ntz", "unnamed:_1": "bigint"}
    assert {(r.title, r.year, r.open, r.seen) for r in journals.collect()} == {
        ("A & B", 2001, True, day), ("C", None, False, None), ("G", 2002, None, None)
    }
    books = sheets["Books"]
    assert dict(books.dtypes) == {"title": "string", "price": "double", "mixed": "string", "title.1": "string"}
    assert {tuple(r) for r in books.collect()} == {("D", 2.5, "1", "E"), ("F", 3.0, "x", None)}
    rows = ingest(sheets)
    assert rows.count() == 5 and rows.select("row_id").distinct().count() == 5
    assert workbook_cells(spark, str(tmp_path)).select("file").distinct().count() == 2
