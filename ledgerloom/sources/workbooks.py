"""Spreadsheet workbooks (.xlsx) as a table of rows, read and written by the executors.

Reading: Spark loads the files and deals them to tasks; a task reads its sheets row by row, so no row passes through the
driver. A file is one task's work; the format holds 1,048,576 rows a sheet. Cells come as text: whole numbers without a
decimal point, dates (by their style) as yyyy-MM-dd, with the time where there is one.

Writing: a sink for (workbook, sheet, row, cells). The rows of a workbook meet in one task in the order of sheet and row
and are streamed into its file under a draft's name; only when all tasks have ended does the commit move the drafts to
their places. A job that fails leaves no workbook.
"""

from __future__ import annotations

import datetime
import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

# The format's rows of a sheet and letters of a sheet's name, its built-in date styles, its namespaces.
MOST_ROWS, MOST_NAME = 1_048_576, 31
DATE_STYLES = frozenset({*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)})
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Rows of an Arrow batch.
BATCH = 1000


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _letters(col: int) -> str:
    out = ""
    col += 1
    while col:
        col, r = divmod(col - 1, 26)
        out = chr(65 + r) + out
    return out


def _all_text(e: ElementTree.Element) -> str:
    """A string's runs, without how it is to be read aloud."""
    return "".join(t.text or "" for child in e for t in ([child] if child.tag == f"{_MAIN}t" else child.iter(f"{_MAIN}t") if child.tag == f"{_MAIN}r" else []))


def _dated(z: zipfile.ZipFile) -> list[bool]:
    """Of each cell style whether it shows a date."""
    if "xl/styles.xml" not in z.namelist():
        return []
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {}
    for f in root.iter(f"{_MAIN}numFmt"):
        code = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode", ""))
        own[int(f.get("numFmtId"))] = bool(re.search(r"[ymdhs]", code, re.I)) and "General" not in code
    xfs = root.find(f"{_MAIN}cellXfs")
    return [own.get(i, i in DATE_STYLES) for i in (int(x.get("numFmtId", "0")) for x in xfs)] if xfs is not None else []


def _number(text: str, dated: bool, base: datetime.datetime) -> str:
    try:
        n = float(text)
    except ValueError:
        return text
    if dated and 0 <= n < 2_958_466:
        at = base + datetime.timedelta(days=int(n), seconds=round((n % 1) * 86400))
        return at.strftime("%Y-%m-%d" if (at.hour, at.minute, at.second) == (0, 0, 0) else "%Y-%m-%d %H:%M:%S")
    return str(int(n)) if n == int(n) and abs(n) < 1e15 else repr(n)


def sheet_rows(content: bytes) -> Iterator[tuple[str, int, int, list[str | None]]]:
    """(sheet, its place from 0, row from 1, cells) of a workbook, blank rows left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        shared = [_all_text(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")] if "xl/sharedStrings.xml" in names else []
        dated = _dated(z)
        props = book.find(f"{_MAIN}workbookPr")
        base = datetime.datetime(1904, 1, 1) if props is not None and props.get("date1904") in ("1", "true") else datetime.datetime(1899, 12, 30)
        for place, sheet in enumerate(book.iter(f"{_MAIN}sheet")):
            target = links[sheet.get(f"{_REL}id")]
            file = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if file not in names:  # a chart
                continue
            last = 0
            with z.open(file) as f:
                for _, row in ElementTree.iterparse(f):
                    if row.tag != f"{_MAIN}row":
                        continue
                    last = int(row.get("r") or last + 1)
                    cells: list[str | None] = []
                    for c in row.iter(f"{_MAIN}c"):
                        at, kind, v = _column(c.get("r")) if c.get("r") else len(cells), c.get("t"), c.find(f"{_MAIN}v")
                        inline = c.find(f"{_MAIN}is")
                        value = _all_text(inline) if inline is not None else None if v is None or v.text is None else v.text
                        if value is not None and kind == "s":
                            value = shared[int(value)]
                        elif value is not None and kind == "b":
                            value = "TRUE" if value == "1" else "FALSE"
                        elif value is not None and kind in (None, "n"):
                            style = int(c.get("s", "0"))
                            value = _number(value, style < len(dated) and dated[style], base)
                        cells += [None] * (at - len(cells)) + [value]
                    row.clear()
                    if any(c not in (None, "") for c in cells):
                        yield sheet.get("name"), place, last, cells


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, place, row, cells array<string>) of all .xlsx files in a folder and below it, or of one file. A file
    that is no workbook is an error that names it."""
    reader = spark.read.format("binaryFile")
    files = reader.load(path) if path.lower().endswith(".xlsx") else reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.xlsx").load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string())]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["file", "sheet", "place", "row", "cells"])
        for batch in batches:
            for i in range(batch.num_rows):
                name, rows = batch.column(0)[i].as_py(), []
                try:
                    for r in sheet_rows(batch.column(1)[i].as_py()):
                        rows.append((name, *r))
                        if len(rows) == BATCH:
                            yield made(rows)
                            rows = []
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    raise ValueError(f"no workbook: {name}: {e}") from e
                if rows:
                    yield made(rows)

    return files.select(F.url_decode(F.col("path")).alias("path"), "content").mapInArrow(run, "file string, sheet string, place int, row int, cells array<string>")


class _Book:
    """A workbook's file while its rows come in."""

    def __init__(self, stream) -> None:  # noqa: ANN001
        self.zip, self.sheets, self.out, self.row = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED), [], None, 0

    def _end_sheet(self) -> None:
        if self.out:
            self.out.write(b"</sheetData></worksheet>")
            self.out.close()
        self.out = None

    def sheet(self, name: str) -> None:
        self._end_sheet()
        plain = re.sub(r"[\[\]:*?/\\]", "_", name)[:MOST_NAME] or "Sheet"
        taken, n = {s.lower() for s in self.sheets}, 1
        while plain.lower() in taken:
            n += 1
            plain = f"{re.sub(r' [(][0-9]+[)]$', '', plain)[: MOST_NAME - 6]} ({n})"
        self.sheets.append(plain)
        self.out, self.row = self.zip.open(f"xl/worksheets/sheet{len(self.sheets)}.xml", "w", force_zip64=True), 0
        self.out.write(b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')

    def add(self, row: int, cells: list[str | None]) -> None:
        cut = [f'<row r="{row}">']
        for i, c in enumerate(cells):
            if c is not None:
                ref = f"{_letters(i)}{row}"
                text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", c)  # no characters of XML
                number = re.fullmatch(r"-?(?:0|[1-9][0-9]{0,14})(?:\.[0-9]*[1-9])?", c) and len(c) <= 16 and c != "-0"
                cut.append(f'<c r="{ref}"><v>{c}</v></c>' if number else f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>')
        self.out.write("".join([*cut, "</row>"]).encode())

    def close(self) -> None:
        if not self.sheets:
            self.sheet("Sheet")
        self._end_sheet()
        n = range(1, len(self.sheets) + 1)
        head, office = '<?xml version="1.0" encoding="UTF-8"?>', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in n)
        parts = {
            "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>',
            "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{escape(s, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, s in zip(n, self.sheets, strict=True)) + "</sheets></workbook>",
            "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + "</Relationships>",
        }
        for name, body in parts.items():
            self.zip.writestr(name, head + body)
        self.zip.close()


@dataclass
class _Drafts(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path, self.run = path.rstrip("/"), f"_drafts-{uuid.uuid4().hex}"

    def _fs(self):  # noqa: ANN202
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")

    def write(self, rows: Iterator) -> _Drafts:
        from pyspark import TaskContext

        store, root = self._fs()
        folder = f"{root}/{self.run}/{TaskContext.get().taskAttemptId()}"  # an attempt that is made again has its own
        store.create_dir(folder, recursive=True)
        names, book, stream, name, sheet, shift = [], None, None, None, None, 0

        def end() -> None:
            if book:
                book.close()
                stream.close()

        for r in rows:
            if book is None or r.workbook != name:
                end()
                name, sheet = r.workbook, None
                names.append(f"{folder}/{name}")
                stream = store.open_output_stream(names[-1])
                book = _Book(stream)
            if r.sheet != sheet:
                sheet, shift = r.sheet, 0
                book.sheet(sheet)
            if r.row - shift > MOST_ROWS:  # goes on in a further sheet
                shift += MOST_ROWS
                book.sheet(sheet)
            book.add(r.row - shift, r.cells)
        end()
        return _Drafts(names)

    def commit(self, messages: list[_Drafts | None]) -> None:
        store, root = self._fs()
        for m in messages:
            for draft in m.names if m else ():
                store.move(draft, f"{root}/{draft.rsplit('/', 1)[1]}")
        self._clear(store, root)

    def abort(self, messages: list[_Drafts | None]) -> None:
        self._clear(*self._fs())

    def _clear(self, store, root: str) -> None:  # noqa: ANN001
        from pyarrow.fs import FileType

        if store.get_file_info(f"{root}/{self.run}").type == FileType.Directory:
            store.delete_dir(f"{root}/{self.run}")


class WorkbookSink(DataSource):
    """Spark's sink of workbooks: rows (workbook, sheet, row, cells), those of a workbook in one task, sorted."""

    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def schema(self) -> str:
        return "workbook string, sheet string, row int, cells array<string>"

    def writer(self, schema, overwrite: bool) -> _Writer:  # noqa: ANN001
        return _Writer(self.options["path"])


def write_workbooks(rows: DataFrame, path: str) -> None:
    """Writes (workbook, sheet, place, row, cells) as a file for each workbook, named by it: sheets by place, rows by number,
    from 1. A workbook of that name in the folder is replaced. Null cells are left out, and characters that XML can't hold;
    numbers that read back as they are become numbers; names of sheets that the format forbids are changed."""
    rows.sparkSession.dataSource.register(WorkbookSink)
    own = rows.select("workbook", "sheet", "place", F.col("row").cast("int").alias("row"), "cells")
    laid = own.repartition("workbook").sortWithinPartitions("workbook", "place", "sheet", "row")
    laid.select("workbook", "sheet", "row", "cells").write.format("workbooks").option("path", path).mode("append").save()


def sheet(df: DataFrame, workbook: str, name: str, place: int, *order: str, first_row: int = 1, first_column: int = 0, header: bool = True, most: int | None = None) -> DataFrame:
    """A table's rows as (workbook, sheet, place, row, cells): a header row, then the rows of each workbook in order; from
    first_row and first_column on. most: a paper's own number of rows, where its template has no more."""
    columns = [c for c in df.columns if c != workbook]
    shown = lambda cs: F.concat(F.array_repeat(F.lit(None).cast("string"), first_column), F.array(*cs))
    at = F.row_number().over(W.partitionBy(workbook).orderBy(*order))
    body = df.withColumn("__at", at)
    if most is not None:
        body = body.where(F.col("__at") <= most)
    fixed = [F.col(workbook).cast("string").alias("workbook"), F.lit(name).alias("sheet"), F.lit(place).alias("place")]
    made = body.select(*fixed, (F.col("__at") + (first_row if header else first_row - 1)).alias("row"), shown([F.col(f"`{c}`").cast("string") for c in columns]).alias("cells"))
    if not header:
        return made
    return df.select(workbook).distinct().select(*fixed, F.lit(first_row).alias("row"), shown([F.lit(c) for c in columns]).alias("cells")).unionByName(made)


# Rows that the official papers' templates hold, their first row, and the first paper's columns B to V.
PAPER_ROWS = {"01010": 16, "01010.2": 20, "01010.3": 20, "01010.4": 19, "01030": 15}
PAPER_FIRST_ROW = 22
PAPER_COLUMNS = ("sample_no", "voucher", "customer", "qty_book", "amt_book", "contract_idx", "contract_terms", "order_no", "transport", "delivery_type", "delivery_no", "receipt_date", "qty_doc", "amt_sales", "qty_diff", "amt_diff", "step1", "step21", "step22", "all_ok", "exception")


def paper(df: DataFrame, workbook: str, name: str, *order: str, kind: str = "01010") -> DataFrame:
    """The rows of an official paper at their places in its template: from row 22 and column B, as many as it has room for
    (the paper's own limit), and below them a note of how many there were."""
    most = PAPER_ROWS[kind]
    own = df.select(workbook, *(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in PAPER_COLUMNS), *(c for c in order if c not in PAPER_COLUMNS and c != workbook))
    rows = sheet(own, workbook, name, 0, *order, first_row=PAPER_FIRST_ROW, first_column=1, header=False, most=most)
    rows = rows.withColumn("cells", F.slice("cells", 1, 1 + len(PAPER_COLUMNS)))
    counted = df.groupBy(workbook).agg(F.count("*").alias("n"))
    note = F.concat(F.lit("rows: "), F.least("n", F.lit(most)).cast("string"), F.lit(" of "), F.col("n").cast("string"))
    below = max(45, PAPER_FIRST_ROW + most + 3)
    return rows.unionByName(counted.select(F.col(workbook).cast("string").alias("workbook"), F.lit(name).alias("sheet"), F.lit(0).alias("place"), F.lit(below).alias("row"), F.array(F.lit(None).cast("string"), note).alias("cells")))
