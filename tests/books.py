"""Hand-made workbooks with the odd cells real ones have."""

import zipfile

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def write_book(path, sheets, shared=None, prefix=""):
    """``sheets`` is [(name, sheetData XML)]; ``shared`` is the XML of the shared string items."""
    p = prefix + ":" if prefix else ""
    ns = f'xmlns:{prefix}="{MAIN}"' if prefix else f'xmlns="{MAIN}"'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        listed = "".join(f'<{p}sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, (n, _) in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<{p}workbook {ns} xmlns:r="{REL}"><{p}sheets>{listed}</{p}sheets></{p}workbook>')
        relations = "".join(f'<Relationship Id="rId{i}" Type="x" Target="/xl/worksheets/s{i}.xml"/>'
                            for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="p">{relations}</Relationships>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<{p}sst {ns}>{shared}</{p}sst>')
        for i, (_, rows) in enumerate(sheets, 1):
            z.writestr(f"xl/worksheets/s{i}.xml", f'<{p}worksheet {ns}><{p}sheetData>{rows}</{p}sheetData></{p}worksheet>')
    return str(path)


def simple_book(path, rows, sheet="Sheet1"):
    """Rows of Python values; numbers become number cells, None leaves the cell out."""
    def cell(column, n, value):
        ref = f"{chr(65 + column)}{n}"
        if value is None:
            return ""
        if isinstance(value, bool):
            return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, (int, float)):
            return f'<c r="{ref}"><v>{value}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t>{value}</t></is></c>'

    body = "".join(f'<row r="{n}">' + "".join(cell(i, n, v) for i, v in enumerate(row)) + "</row>"
                   for n, row in enumerate(rows, 1))
    return write_book(path, [(sheet, body)])
