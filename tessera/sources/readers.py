"""Readers and writers with explicit schemas."""

from __future__ import annotations

import xml.etree.ElementTree as ET
import zipfile
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from ..model import CONTACT


def read_contacts_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """An array of contact records (one document), or with ``lines`` a record per line as ``write_json`` leaves them, which
    can be split over tasks; empty texts as null."""
    df = spark.read.schema(CONTACT).option("multiLine", not lines).json(path)
    return df.select([F.nullif(F.col(f.name), F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in CONTACT])


def read_address_book(contacts: DataFrame) -> DataFrame:
    """Only what the address operators need: name, email, firm, ctype, source of rows with a name."""
    return contacts.select(*[strip(F.col(c).cast("string")).alias(c) for c in ("name", "email", "firm", "ctype", "source")]).filter("name is not null")


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with header as text columns, by name; a missing file is an empty table."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm):
        return spark.createDataFrame([], schema)
    got = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    got = got.withColumnsRenamed({c: c.lstrip("﻿") for c in got.columns})
    return got.select([F.col(f"`{c}`") if c in got.columns else F.lit(None).cast("string").alias(c) for c in columns])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line: non-blank lines that are no comment."""
    return spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> '' and not startswith(line, '#')")


def read_xlsx(path: str | Path, sheet: str, first_row: int = 1) -> list[list[object]]:
    """Cell values of one sheet of a workbook, by position, read on the driver with the standard library
    (a workbook is bounded by its format); numbers as float, texts as str, empty cells as None."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(path) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        at = next(s.get(rel) for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{{{ns['m']}}}sheet") if s.get("name") == sheet)
        tree = ET.fromstring(z.read("xl/" + targets[at].removeprefix("/xl/")))
    rows = []
    for at, row in enumerate(tree.iter(f"{{{ns['m']}}}row"), 1):
        if int(row.get("r", at)) < first_row:
            continue
        values: list[object] = []
        for k, c in enumerate(row.findall("m:c", ns)):
            letters = "".join(x for x in c.get("r", "") if x.isalpha())
            col = k if not letters else sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters))) - 1
            values += [None] * (col + 1 - len(values))
            v, kind = c.find("m:v", ns), c.get("t")
            if kind == "inlineStr":
                values[col] = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t"))
            elif v is not None and v.text is not None:
                values[col] = shared[int(v.text)] if kind == "s" else v.text if kind in ("str", "e") else float(v.text)
        rows.append(values)
    return rows


def read_sheet(spark: SparkSession, path: str | Path, sheet: str, columns: list[str], first_row: int = 2) -> DataFrame:
    """One sheet of a workbook as a table of texts, columns by position; missing cells are null, rows without any value
    are left out, and row_no is the place of the row."""
    def text(v: object) -> str | None:
        return None if v is None else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)

    rows = []
    for n, values in enumerate(read_xlsx(path, sheet, first_row), first_row):
        cells = [text(v) for v in [*values, *[None] * len(columns)][: len(columns)]]
        if any(c is not None for c in cells):
            rows.append((*cells, n))
    schema = T.StructType([*(T.StructField(c, T.StringType()) for c in columns), T.StructField("row_no", T.IntegerType())])
    return spark.createDataFrame(rows, schema)


SHEET_ROWS = 1_048_576  # what the format holds


def write_workbook(path: str | Path, tabs: dict[str, DataFrame]) -> None:
    """One tab per table, header first, in the order given. Rows stream through the driver one partition at a time; a table
    with more rows than a sheet holds is refused."""
    def cell(v: object) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, int | float) and not isinstance(v, bool):
            return f"<c><v>{v}</v></c>"
        text = "".join(c for c in str(v) if c >= " " or c in "\t\n\r")
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'

    office, package = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006"
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = ['<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>']
        for k, df in enumerate(tabs.values(), 1):
            kinds.append(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>')
            with z.open(f"xl/worksheets/sheet{k}.xml", "w", force_zip64=True) as out:
                out.write(f'<worksheet xmlns="{main}"><sheetData><row>{"".join(map(cell, df.columns))}</row>'.encode())
                for n, row in enumerate(df.toLocalIterator(), 2):
                    if n > SHEET_ROWS:
                        raise ValueError(f"more than {SHEET_ROWS - 1} rows in a tab")
                    out.write(f"<row>{''.join(map(cell, row))}</row>".encode())
                out.write(b"</sheetData></worksheet>")
        names = "".join(f'<sheet name="{escape(t)}" sheetId="{k}" r:id="rId{k}"/>' for k, t in enumerate(tabs, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">{"".join(f"""<Relationship Id="rId{k}" Type="{office}/worksheet" Target="worksheets/sheet{k}.xml"/>""" for k in range(1, len(tabs) + 1))}</Relationships>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{"".join(kinds)}</Types>')


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """The given columns in their order; missing ones and nulls are empty."""
    df.select([F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]).write.mode("overwrite").option("header", True).option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("escape", '"').csv(path)
