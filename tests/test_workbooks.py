import os
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import files, workbooks


def read(spark, path):
    return sorted((os.path.basename(r.file), r.place, r.sheet, r.row, list(r.cells)) for r in workbooks.read_workbooks(spark, path).collect())


def test_round_trip_of_many_workbooks(spark, tmp_path):
    odd = ["", " a ", "é漢😀", "<&\"'>", "007", "1.50", "12", "-3.25", "1e5", "0", "-0", "1" * 20, "line\nbreak", "\x01x"]
    rows = [(f"book{i} 号.xlsx", s, p, r, [odd[(i + r) % len(odd)], None, odd[(i * r) % len(odd)], f"{i}"]) for i in range(200) for p, s in enumerate(["A", "订单/1"]) for r in (1, 2, 5)]
    df = spark.createDataFrame(rows, "workbook string, sheet string, place int, row int, cells array<string>")
    workbooks.write_workbooks(df, f"{tmp_path}/out")
    assert len(os.listdir(f"{tmp_path}/out")) == 200
    want = sorted((w, p, s.replace("/", "_"), r, [None if c is None else c.replace("\x01", "") for c in cells]) for w, s, p, r, cells in rows)
    assert read(spark, f"{tmp_path}/out") == want
    assert read(spark, f"{tmp_path}/out/book7 号.xlsx") == [w for w in want if w[0] == "book7 号.xlsx"]


def test_a_failed_job_leaves_no_workbook(spark, tmp_path):
    df = spark.createDataFrame([(f"b{i}", "s", 0, 1, ["x"]) for i in range(20)], "workbook string, sheet string, place int, row int, cells array<string>")
    bad = df.withColumn("cells", F.when(F.col("workbook") == "b7", F.raise_error(F.lit("lost"))).otherwise(F.col("cells")))
    with pytest.raises(Exception, match="lost"):
        workbooks.write_workbooks(bad, f"{tmp_path}/out")
    assert not os.path.isdir(f"{tmp_path}/out") or os.listdir(f"{tmp_path}/out") == []


def test_tables_and_papers_as_sheets(spark, tmp_path):
    df = spark.createDataFrame([("a.xlsx", i, f"c{i}") for i in range(30)] + [("b.xlsx", 1, "d")], "book string, sample_no int, customer string")
    workbooks.write_workbooks(workbooks.paper(df, "book", "P", "sample_no").unionByName(workbooks.sheet(df, "book", "all", 1, "sample_no")), f"{tmp_path}/p")
    got = read(spark, f"{tmp_path}/p")
    first = [r for r in got if r[:2] == ("a.xlsx", 0)]
    assert [r[3] for r in first] == [*range(22, 38), 45] and first[0][4][:4] == [None, "0", None, "c0"] and first[-1][4] == [None, "rows: 16 of 30"]
    whole = [r for r in got if r[:2] == ("a.xlsx", 1)]
    assert whole[0][4] == ["sample_no", "customer"] and len(whole) == 31 and whole[30][3:] == (31, ["29", "c29"])
    assert [r[4] for r in got if r[0] == "b.xlsx" and r[1] == 0][-1] == [None, "rows: 1 of 1"]


def test_dates_shared_strings_and_gaps(spark, tmp_path):
    path, main = f"{tmp_path}/d.xlsx", "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="x"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="x" Target="/xl/worksheets/one.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>入账日期</t></si><si><r><t>two </t></r><r><t>runs</t></r><rPh><t>no</t></rPh></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="170" formatCode="yyyy/m/d h:mm"/><numFmt numFmtId="171" formatCode="0.00&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        cells = '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c></row><row/><row r="9"><c s="1"><v>45000</v></c><c s="2"><v>45000.5</v></c><c s="3"><v>45000.5</v></c><c t="b"><v>1</v></c><c t="str"><f>A1</f><v>made</v></c><c t="e"><v>#N/A</v></c><c/></row>'
        z.writestr("xl/worksheets/one.xml", f'<worksheet xmlns="{main}"><sheetData>{cells}</sheetData></worksheet>')
    assert read(spark, path) == [("d.xlsx", 0, "S", 2, ["入账日期", None, "two runs"]), ("d.xlsx", 0, "S", 9, ["2023-03-15", "2023-03-15 12:00:00", "45000.5", "TRUE", "made", "#N/A", None])]
    ledger = files.read_ledger(spark, path)
    assert ledger.columns == ["入账日期", "column2", "two runs", "column4", "column5", "column6", "column7"] and ledger.count() == 1
    open(f"{tmp_path}/e.xlsx", "w").write("none")
    with pytest.raises(Exception, match="no workbook"):
        read(spark, f"{tmp_path}")
