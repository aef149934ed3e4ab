"""The first sheet of .xlsx files as a Spark data source, by the standard library alone."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


# The number formats that show dates and times without saying so in the workbook.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def date_styles(z: zipfile.ZipFile) -> set[int]:
    """The cell styles that show a number as a date or time."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    styles = ElementTree.fromstring(z.read("xl/styles.xml"))
    plain = lambda code: re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code).lower()  # noqa: E731  without literals, colours and conditions
    own = {int(f.get("numFmtId")) for f in styles.iter(f"{_MAIN}numFmt") if re.search("[ydhs]|m{2}", plain(f.get("formatCode", "")))}
    formats = styles.find(f"{_MAIN}cellXfs")
    return {k for k, x in enumerate(formats if formats is not None else []) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}


def moment(serial: str, from_1904: bool) -> str:
    """A date's number as text; numbers below 1 are times of day, and what is no number stays."""
    try:
        days = float(serial)
    except ValueError:
        return serial
    at = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30)  # days count from a leap day that 1900 did not have
    at += timedelta(seconds=round(days * 86400))
    return at.strftime("%H:%M:%S") if 0 <= days < 1 else at.strftime("%Y-%m-%d %H:%M:%S")


def first_sheet(data: bytes) -> Iterator[list[str | None]]:
    """The rows of the first sheet as texts; dates as YYYY-MM-DD hh:mm:ss; a cell without a value is None."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_MAIN}si")]
        book, dates = ElementTree.fromstring(z.read("xl/workbook.xml")), date_styles(z)
        settings = book.find(f"{_MAIN}workbookPr")
        from_1904 = settings is not None and settings.get("date1904") in ("1", "true")
        sheet = book.find(f"{_MAIN}sheets")[0]
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = links[sheet.get(_LINK)].lstrip("/")
        with z.open(target if target.startswith("xl/") else f"xl/{target}") as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_MAIN}row":
                    continue
                out: list[str | None] = []
                for k, cell in enumerate(row.findall(f"{_MAIN}c")):
                    at = _column(cell.get("r")) if cell.get("r") else k
                    out += [None] * (at + 1 - len(out))
                    value, kind = cell.find(f"{_MAIN}v"), cell.get("t")
                    if kind == "inlineStr":
                        out[at] = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                    elif value is not None and value.text is not None and kind in (None, "n") and int(cell.get("s", 0)) in dates:
                        out[at] = moment(value.text, from_1904)
                    elif value is not None and value.text is not None:
                        out[at] = shared[int(value.text)] if kind == "s" else {"1": "true", "0": "false"}.get(value.text, value.text) if kind == "b" else value.text
                yield out
                row.clear()


class _File(InputPartition):
    def __init__(self, data: bytes):
        self.data = data


class _Reader(DataSourceReader):
    def __init__(self, width: int, data: bytes):
        self.width, self.data = width, data

    def partitions(self):
        return [_File(self.data)]

    def read(self, partition):
        rows = first_sheet(partition.data)
        next(rows, None)
        for row in rows:
            yield tuple((row + [None] * self.width)[: self.width])


class ExcelDataSource(DataSource):
    """Format ``clarifex_xlsx`` with the option ``data``, the file in hexadecimal: a workbook is a small file, read whole. All columns are texts."""

    @classmethod
    def name(cls):
        return "clarifex_xlsx"

    def schema(self):
        header = next(first_sheet(bytes.fromhex(self.options["data"])), [])
        return ", ".join(f"`{(h or f'_c{k}').replace('`', '``')}` string" for k, h in enumerate(header))

    def reader(self, schema):
        return _Reader(len(schema.fields), bytes.fromhex(self.options["data"]))
