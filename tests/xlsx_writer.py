"""A minimal .xlsx writer for test inputs (zipfile + XML text)."""

from __future__ import annotations

import zipfile
from xml.sax.saxutils import escape


def _col(n: int) -> str:
    s = ""
    while n:
        n, r = divmod(n - 1, 26)
        s = chr(65 + r) + s
    return s


def _cell(ref: str, v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)):
        return f'<c r="{ref}"><v>{v}</v></c>'
    if isinstance(v, tuple) and v[0] == "date":  # ("date", excel serial)
        return f'<c r="{ref}" s="1"><v>{v[1]}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'


def write_xlsx(path: str, sheets: list[tuple[str, str, list[list]]]) -> None:
    """``sheets``: ``[(name, state, rows)]``; state is visible / hidden."""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"/>')
        sheet_xml, rels = [], []
        for i, (name, state, _) in enumerate(sheets, start=1):
            st = "" if state == "visible" else f' state="{state}"'
            sheet_xml.append(f'<sheet name="{escape(name)}" sheetId="{i}"{st} r:id="rId{i}"/>')
            rels.append(f'<Relationship Id="rId{i}" Type="worksheet" Target="worksheets/sheet{i}.xml"/>')
        z.writestr(
            "xl/workbook.xml",
            '<?xml version="1.0"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
            'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>'
            + "".join(sheet_xml) + "</sheets></workbook>",
        )
        z.writestr(
            "xl/_rels/workbook.xml.rels",
            '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            + "".join(rels) + "</Relationships>",
        )
        z.writestr(
            "xl/styles.xml",
            '<?xml version="1.0"?><styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
            '<cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        )
        for i, (_, _, rows) in enumerate(sheets, start=1):
            body = []
            for r, row in enumerate(rows, start=1):
                cells = "".join(_cell(f"{_col(c)}{r}", v) for c, v in enumerate(row, start=1))
                body.append(f'<row r="{r}">{cells}</row>')
            z.writestr(
                f"xl/worksheets/sheet{i}.xml",
                '<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
                "<sheetData>" + "".join(body) + "</sheetData></worksheet>",
            )
