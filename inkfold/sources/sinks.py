"""JSON and workbook outputs."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, functions as F

#: Headings of the agreed sheet: a first row of groups over a second row. Fixed values.
HEADINGS = [
    "ลำดับ", "วัน เดือน ปี", "ชื่อและความแรง", "ชื่อการค้า", "เลขที่/รุ่นที่/ครั้งที่ผลิต", "ได้มาจาก", "จ่ายไปให้", "เลขประจำตัว", "ยอดยกมา", "รับ", "จ่าย", "คงเหลือ",
]
PAGE_HEADINGS = ["หน้า", "แบบฟอร์ม", "จำนวนแถว", "เอียง (องศา)", "Confidence", "ปัญหา"]


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text for each row, with null fields and non-ASCII text kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    as_json(df).write.mode("overwrite").text(path)


def _column(n: int) -> str:
    name = ""
    while n >= 0:
        name, n = chr(65 + n % 26) + name, n // 26 - 1
    return name


def _sheet(rows: Iterable[tuple[list, int]], merges: list[str]) -> str:
    body = []
    for r, (cells, style) in enumerate(rows, 1):
        parts = []
        for c, value in enumerate(cells):
            at = f'r="{_column(c)}{r}" s="{style}"'
            if value is None or value == "":
                parts.append(f"<c {at}/>")
            elif isinstance(value, (int, float)) and not isinstance(value, bool):
                parts.append(f"<c {at}><v>{value}</v></c>")
            else:
                parts.append(f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>')
        body.append(f'<row r="{r}">{"".join(parts)}</row>')
    merged = f'<mergeCells count="{len(merges)}">{"".join(f"<mergeCell ref=\"{m}\"/>" for m in merges)}</mergeCells>' if merges else ""
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{"".join(body)}</sheetData>{merged}</worksheet>'


def workbook(rows: list[dict], pages: list[dict]) -> bytes:
    """The workbook of one document: sheet Output with a merged two-row heading and shaded review rows, and a sheet of its pages.

    A document's rows are few; call it for one document at a time, in applyInPandas or on the driver.
    """
    from inkfold.operators.ledger import OUTPUT

    lines = [(HEADINGS, 1), ([""] * len(HEADINGS), 1)] + [([r.get(k) for k in OUTPUT], 2 if r.get("needs_review") else 0) for r in rows]
    merges = [f"{_column(c)}1:{_column(c)}2" for c in range(len(HEADINGS))]
    summary = [(PAGE_HEADINGS, 1)] + [([p.get(k) for k in ("page", "form", "rows", "skew", "confidence", "error")], 0) for p in pages]
    kind = "http://schemas.openxmlformats.org"
    files = {
        "[Content_Types].xml": f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{kind}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>'
        + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in (1, 2)) + "</Types>",
        "_rels/.rels": f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{kind}/package/2006/relationships"><Relationship Id="r1" Type="{kind}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{kind}/spreadsheetml/2006/main" xmlns:r="{kind}/officeDocument/2006/relationships"><sheets><sheet name="Output" sheetId="1" r:id="r1"/><sheet name="สรุปรายหน้า" sheetId="2" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{kind}/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{kind}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in (1, 2)) + f'<Relationship Id="r3" Type="{kind}/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="{kind}/spreadsheetml/2006/main"><fonts count="2"><font/><font><b/></font></fonts><fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FFFFF2CC"/></patternFill></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf/><xf fontId="1" applyFont="1"/><xf fillId="2" applyFill="1"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": _sheet(lines, merges),
        "xl/worksheets/sheet2.xml": _sheet(summary, []),
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in files.items():
            archive.writestr(name, text)
    return out.getvalue()
