"""Grids and texts out of HTML tables, spreadsheets and documents, one file or text at a time inside tasks, and what to unpack of an archive."""

from __future__ import annotations

import io
import re
import sys
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Functions sent to executors travel by value, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Entries of an archive, and bytes of them unpacked, at most: fixed values of what is to be unpacked, the others are listed as left out.
MOST_ENTRIES, MOST_BYTES = 20, 40 << 20
CELLS = "table int, row int, col int, value string"


#: Columns and rows that a cell may span, as browsers have it.
MOST_COLUMNS, MOST_ROWS = 1000, 65534


def _span(value: str | None, most: int, zero: int = 1) -> int:
    """Cells that an attribute asks for: 1 unless it is a number, `zero` for 0."""
    given = re.match(r"\s*([0-9]+)", value or "1")
    return min(int(given[1]), most) or zero if given else 1


@dataclass
class _Grid:
    """A table that is being read: its cells with what they span, and where cells of rows above reach down."""

    number: int
    row: int = -1
    col: int = 0
    cells: list = field(default_factory=list)  # row, col, rows, cols, pieces of text
    reaching: list = field(default_factory=list)  # last row, first column, one after the last column
    open: bool = False

    def new_row(self) -> None:
        self.row, self.col, self.open = self.row + 1, 0, False
        self.reaching = [x for x in self.reaching if x[0] >= self.row]

    def new_cell(self, rows: int, cols: int) -> None:
        if self.row < 0:
            self.new_row()
        while over := [x[2] for x in self.reaching if x[1] <= self.col < x[2]]:
            self.col = max(over)
        self.cells.append((self.row, self.col, rows, cols, []))
        if rows > 1:
            self.reaching.append((self.row + rows - 1, self.col, self.col + cols))
        self.col, self.open = self.col + cols, True

    def values(self) -> Iterator[tuple[int, int, int, str]]:
        """A place that two cells span keeps the value of the upper, then the left one; spans end with the table's last row."""
        taken = {}
        for row, col, rows, cols, text in self.cells:
            value = re.sub(r"[ \t\xa0]+", " ", "".join(text)).strip()
            for r in range(row, min(row + rows, self.row + 1)):
                for c in range(col, col + cols):
                    taken.setdefault((r, c), value)
        return ((self.number, r, c, taken[r, c]) for r, c in sorted(taken))


class _Tables(HTMLParser):
    """Grids of the tables of a page, numbered as they open. A table within a cell is one of its own, and not part of the cell's text."""

    def __init__(self) -> None:
        super().__init__()
        self.cells: list[tuple[int, int, int, str]] = []
        self.open: list[_Grid] = []
        self.tables = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table" or tag in ("tr", "td", "th") and not self.open:
            self.open.append(_Grid(self.tables))
            self.tables += 1
        grid = self.open[-1] if self.open else None
        if tag == "tr":
            grid.new_row()
        elif tag in ("td", "th"):
            given = dict(attrs)
            grid.new_cell(_span(given.get("rowspan"), MOST_ROWS, MOST_ROWS), _span(given.get("colspan"), MOST_COLUMNS))
        elif tag == "br":
            self.handle_data("\n")

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1].open:
            self.open[-1].cells[-1][4].append(data)

    def handle_endtag(self, tag: str) -> None:
        if self.open and tag in ("td", "th", "tr"):
            self.open[-1].open = False
        elif self.open and tag == "table":
            self.cells += self.open.pop().values()

    def close(self) -> None:
        super().close()
        while self.open:
            self.cells += self.open.pop().values()


def html_cells(page: str) -> Iterator[tuple[int, int, int, str]]:
    """Table, row, column and value of each place of the tables of a page; a cell that spans several is in all of them."""
    parser = _Tables()
    parser.feed(page)
    parser.close()
    yield from sorted(parser.cells)


def _column(name: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", name)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


# Numbers of the formats that are dates or times of day, before those that a workbook defines.
DATE_FORMATS = [*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)]
EPOCHS = {False: datetime(1899, 12, 30), True: datetime(1904, 1, 1)}


def _is_date(code: str) -> bool:
    """A format with a day, month, year, hour or second outside quotes, brackets and escapes."""
    return bool(re.search("[ymdhs]", re.sub(r'"[^"]*"|\[(?!h+\]|m+\]|s+\])[^\]]*\]|\\.|_.|\*.', "", code.lower())))


def _date(value: str, epoch: datetime) -> str:
    """A serial day as date, date and time, or time of day if it is less than a day."""
    at = epoch + timedelta(seconds=round(float(value) * 86400))
    if float(value) < 1:
        return f"{at:%H:%M:%S}"
    return f"{at:%Y-%m-%d}" if float(value) == int(float(value)) else f"{at:%Y-%m-%d %H:%M:%S}"


def sheet_cells(content: bytes) -> Iterator[tuple[int, int, int, str]]:
    """Cells with a value of each sheet of a workbook: shared and inline strings, dates by their format, other numbers as they are written.

    The value of merged cells is in all of them, down to the sheet's last row that has any.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = {i.filename for i in z.infolist()}
        part = lambda n: ElementTree.fromstring(z.read(n)) if n in names else ElementTree.Element("none")
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        shared = ["".join(t.text or "" for t in item.iter() if t.tag.endswith("}t")) for item in part("xl/sharedStrings.xml")]
        styles = part("xl/styles.xml")
        own = {int(f.get("numFmtId", 0)): _is_date(f.get("formatCode", "")) for f in styles.iter() if f.tag.endswith("}numFmt")}
        used = [int(x.get("numFmtId", 0)) for group in styles if group.tag.endswith("}cellXfs") for x in group]
        dates = {i for i, n in enumerate(used) if own.get(n, n in DATE_FORMATS)}
        epoch = EPOCHS[any(p.get("date1904") in ("1", "true") for p in part("xl/workbook.xml").iter() if p.tag.endswith("}workbookPr"))]
        for k, sheet in enumerate(sheets):
            found, merged = {}, []
            for c in part(sheet).iter():
                if c.tag.endswith("}mergeCell"):
                    merged.append(c.get("ref", "A1"))
                if not c.tag.endswith("}c"):
                    continue
                texts = ["".join(t.text or "" for t in c.iter() if t.tag.endswith(end)) for end in ("}v", "}t")]
                value = shared[int(texts[0])] if c.get("t") == "s" and texts[0] else texts[0] or texts[1]
                if value and c.get("t", "n") == "n" and int(c.get("s", 0)) in dates:
                    value = _date(value, epoch)
                if value:
                    found[_place(c.get("r", "A1"))] = value
            last = max((r for r, _ in found), default=-1)
            for (top, left), (bottom, right) in (sorted(map(_place, (ref.split(":") * 2)[:2])) for ref in merged):
                if (top, left) in found:
                    for r in range(top, min(bottom, last) + 1):
                        for col in range(left, right + 1):
                            found.setdefault((r, col), found[top, left])
            for r, col in sorted(found):
                yield k, r, col, found[r, col]


def _place(name: str) -> tuple[int, int]:
    """Row and column of a cell's name, from 0."""
    return int(re.search(r"\d+$", name)[0]) - 1, _column(name)


def document_text(content: bytes) -> str:
    """Paragraphs of a word-processor document, one a line."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    paragraphs = (p for p in root.iter() if p.tag.endswith("}p"))
    return "\n".join("".join("\t" if t.tag.endswith("}tab") else t.text or "" for t in p.iter() if t.tag.endswith(("}t", "}tab"))) for p in paragraphs)


def cells_of(df: DataFrame, key: str, column: str, parse: Callable) -> DataFrame:
    """key, table, row, col, value: cells of each row's text or file; one that can't be read has none. Null has none."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = []
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    out += [(k, *cell) for cell in parse(raw)] if raw else []
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError):
                    continue
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), *(pa.array(c, pa.int32()) for c in cols[1:4]), pa.array(cols[4], pa.string())], names=[key, "table", "row", "col", "value"])

    return df.select(key, column).mapInArrow(run, f"{key} {kind}, {CELLS}")


def texts_of(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, text of word-processor files; null for what can't be read."""
    kind = df.schema[key].dataType.simpleString()

    def text(raw: bytes | None) -> str | None:
        try:
            return document_text(raw) if raw else None
        except (zipfile.BadZipFile, ElementTree.ParseError, KeyError):
            return None

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([text(r) for r in batch.column(1).to_pylist()], pa.string())], names=[key, "text"])

    return df.select(key, column).mapInArrow(run, f"{key} {kind}, text string")


def grids(cells: DataFrame, key: str) -> DataFrame:
    """key, table, grid: rows as arrays of their values in order of columns. A table's cells meet in one row, as a grid is one value."""
    rows = cells.groupBy(key, "table", "row").agg(F.transform(F.sort_array(F.collect_list(F.struct("col", "value"))), lambda x: x["value"]).alias("values"))
    return rows.groupBy(key, "table").agg(F.transform(F.sort_array(F.collect_list(F.struct("row", "values"))), lambda x: x["values"]).alias("grid"))


def unpacking_plan(entries: DataFrame, archive: str, order: str, size: str, usable: Column | None = None) -> DataFrame:
    """entries with plan: take, or why not: kind, count or size, in the order of an archive; what is left out takes no room."""
    fits = F.coalesce(usable, F.lit(False)) if usable is not None else F.lit(True)
    w = W.partitionBy(archive).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    e = entries.withColumn("fits_", fits)
    place, room = F.count_if("fits_").over(w), F.sum(F.when(F.col("fits_"), F.col(size)).otherwise(0)).over(w)
    plan = F.when(~F.col("fits_"), "kind").when(F.col("place_") > MOST_ENTRIES, "count").when(F.col("room_") > MOST_BYTES, "size").otherwise("take")
    return e.withColumns({"place_": place, "room_": room}).withColumn("plan", plan).drop("fits_", "place_", "room_")


def months_by_skill(cells: DataFrame, key: str, skill_label: str, period_label: str, months) -> DataFrame:
    """key, skill, months out of grids: below a row with both labels, a skill's column and a period's; months reads a period."""
    heads = cells.where(F.col("value").isin(skill_label, period_label)).groupBy(key, "table", "row").agg(F.min(F.when(F.col("value") == skill_label, F.col("col"))).alias("s"), F.min(F.when(F.col("value") == period_label, F.col("col"))).alias("p"))
    heads = heads.where("s is not null and p is not null").groupBy(key, "table").agg(F.min(F.struct("row", "s", "p")).alias("h"))
    j = cells.join(heads, [key, "table"]).where("row > h.row")
    at = lambda c: F.max(F.when(F.col("col") == F.col(f"h.{c}"), F.col("value")))
    rows = j.groupBy(key, "table", "row").agg(at("s").alias("skill"), at("p").alias("period"))
    found = rows.select(key, F.trim("skill").alias("skill"), months(F.col("period")).alias("months")).where("skill != '' and months is not null")
    return found.groupBy(key, "skill").agg(F.sum("months").alias("months"))
