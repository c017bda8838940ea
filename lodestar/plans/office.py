"""Workbooks and documents of suppliers, made as files and read again."""

from __future__ import annotations

import io
import sys
import zipfile

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources import files

from .tables import table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STYLES = '<styleSheet xmlns="m"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>'
#: A name over two rows, a serial day as a date and the same as a number, a balance.
SHEET = """<worksheet xmlns="m"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" s="1"><v>{day}</v></c></row>
<row r="2"><c r="B2"><v>{day}</v></c><c r="C2" t="inlineStr"><is><t>{number}</t></is></c></row></sheetData><mergeCells><mergeCell ref="A1:A2"/></mergeCells></worksheet>"""
DOCUMENT = '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>{name}</w:t><w:tab/><w:t>{number}</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>end</w:t></w:r></w:p></w:body></w:document>'


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def _files(spark: SparkSession, d: str) -> DataFrame:
    """id, book, document; every seventh file is broken."""

    def write(batches):
        for batch in batches:
            rows = batch.to_pylist()
            books = [_zip({"xl/styles.xml": STYLES, "xl/sharedStrings.xml": f'<sst xmlns="m"><si><t>{r["name"]}</t></si></sst>', "xl/worksheets/sheet1.xml": SHEET.format(**r)}) for r in rows]
            texts = [_zip({"word/document.xml": DOCUMENT.format(**r)}) for r in rows]
            broken = lambda r, x: x[:20] if r["number"] % 7 == 0 else x
            yield pa.RecordBatch.from_arrays([batch.column("number"), *(pa.array([broken(r, x) for r, x in zip(rows, xs, strict=True)], pa.binary()) for xs in (books, texts))], names=["id", "book", "document"])

    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("number"), F.col("s_name").alias("name"), (F.col("s_suppkey") + 45000).alias("day"))
    return s.mapInArrow(write, "id long, book binary, document binary")


def sheet_grids(spark: SparkSession, d: str) -> DataFrame:
    cells = files.cells_of(_files(spark, d), "id", "book", files.sheet_cells)
    return cells.select("id", F.col("row").cast("long").alias("nr"), F.col("col").cast("long").alias("place"), "value")


def document_lines(spark: SparkSession, d: str) -> DataFrame:
    return files.texts_of(_files(spark, d), "id", "document").select("id", F.replace(F.replace("text", F.lit("\t"), F.lit("|")), F.lit("\n"), F.lit("/")).alias("text"))


QUERIES = {
    "sheet_grids": (sheet_grids, """SELECT s_suppkey AS id, nr, place, CASE WHEN place = 0 THEN s_name WHEN place = 2 THEN s_suppkey::VARCHAR WHEN nr = 0 THEN strftime(DATE '1899-12-30' + (s_suppkey + 45000)::INT, '%Y-%m-%d') ELSE (s_suppkey + 45000)::VARCHAR END AS value
FROM supplier, (VALUES (0::BIGINT, 0::BIGINT), (1, 0), (0, 1), (1, 1), (1, 2)) v(nr, place) WHERE s_suppkey % 7 != 0"""),
    "document_lines": (document_lines, "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 7 != 0 THEN s_name || '|' || s_suppkey || '//end' END AS text FROM supplier"),
}
