"""The scanner of delimited text against Python's csv module."""

import csv
import io
import random

import pytest

from veilspark.operators import ledger
from veilspark.sources import delimited, readers


def grid(spark, path, **options):
    df = readers.read(spark, path, **options)
    return [tuple(r) for r in df.select(*[c for c in df.columns if c != "_ord"], "_ord").orderBy("_ord").collect()]


def test_quoted_breaks_and_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'name,n\r\n"l1\nl2",2\r\n"say ""hi"", ok",3\r\n\r\n5" pipe,4\r\n"",5\r\n,6\r\nshort\r\nlong,7,8\r\n')
    want = [("l1\nl2", 2, 0), ('say "hi", ok', 3, 1), ('5" pipe', 4, 2), ("", 5, 3), (None, 6, 4), ("short", None, 5), ("long", 7, 6)]
    assert grid(spark, f"{tmp_path}/a.csv", ordered=True) == want
    assert readers.read(spark, f"{tmp_path}/a.csv").columns == ["name", "n"]
    bare = grid(spark, f"{tmp_path}/a.csv", header=False, ordered=True)
    assert bare[0] == ("name", "n", None, 0) and bare[-1] == ("long", "7", "8", 7) and len(bare) == 8


def test_folder_in_order_of_names(spark, tmp_path):
    """Spark deals the largest files first; rows are numbered by the files' names."""
    folder = tmp_path / "f.csv"
    folder.mkdir()
    (folder / "a.csv").write_text("k\n1\n2\n")
    (folder / "b.csv").write_text("k\n" + "\n".join(str(i) for i in range(3, 5000)) + "\n")
    (folder / "c.csv").write_text("k\n5000\n")
    got = grid(spark, str(folder), ordered=True)
    assert got == [(i + 1, i) for i in range(5000)]
    bare = grid(spark, str(folder), header=False, ordered=True)
    assert [r[0] for r in bare if r[0] != "k"] == [str(i) for i in range(1, 5001)] and [r[1] for r in bare] == list(range(5003))
    (folder / "d.csv").write_text('k\n"x\ny"\n')
    assert grid(spark, str(folder), ordered=True)[4999:] == [("5000", 4999), ("x\ny", 5000)]


@pytest.mark.parametrize("sep,end,seed", [(",", "\n", 1), (",", "\r\n", 2), ("\t", "\n", 3)])
def test_splits_of_any_size(spark, tmp_path, sep, end, seed):
    """Splits that begin within quoted cells, in many files, give what one reader of the whole files gives."""
    rng = random.Random(seed)
    want, folder = [], tmp_path / ("x.csv" if sep == "," else "x.tsv")
    folder.mkdir()
    for name in ("p1", "p2", "p3"):
        rows = []
        for _ in range(rng.randrange(100, 200)):
            rows.append(["".join(rng.choice(["a", "b", '"', "\n", sep, " ", "é", "\n\n", '""', "q"]) for _ in range(rng.randrange(0, 30))) for _ in range(4)])
        text = io.StringIO()
        csv.writer(text, delimiter=sep, lineterminator=end, quoting=csv.QUOTE_ALL).writerows(rows)
        (folder / f"{name}.csv").write_text(text.getvalue(), newline="")
        want += rows
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("100", "777", "100000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            got = grid(spark, str(folder), header=False, ordered=True)
            assert got == [(*r, i) for i, r in enumerate(want)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_cells():
    assert delimited.cells_of('a,"b,""c""",,"",d"e,', ",") == ["a", 'b,"c"', None, "", 'd"e', None]
    assert delimited.cells_of('"a"x,b', ",") == ["ax", "b"] and delimited.cells_of('"open, b', ",") == ["open, b"]


def test_edges(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    assert grid(spark, f"{tmp_path}/empty.csv", header=False, ordered=True) == []
    (tmp_path / "latin.csv").write_bytes('n\n"caf\xe9\nx"\n'.encode("latin-1"))
    assert grid(spark, f"{tmp_path}/latin.csv", ordered=True) == [("café\nx", 0)]
    (tmp_path / "open.csv").write_text('n,m\n1,2\n"never closed\n3,4\n')
    assert grid(spark, f"{tmp_path}/open.csv", ordered=True) == [("1", 2, 0), ("never closed\n3,4", None, 1)]
    (tmp_path / "types.csv").write_text('i,b,d,t,s,_x\n1,true,2024-01-05,"a\nb",1.5,\n-2,FALSE,2024-02-01,c,2e3,\n')
    df = readers.read(spark, f"{tmp_path}/types.csv")
    assert [t for _, t in df.dtypes] == ["int", "boolean", "date", "string", "double", "string"]


def test_reports_are_read_whole(spark, tmp_path):
    """A report whose first line is a title keeps all columns, and a folder of parts its order."""
    folder = tmp_path / "r.csv"
    folder.mkdir()
    (folder / "1.csv").write_text("Title\nDoc. No,Doc. Date,Cust Code,Cust Name,,,Total\n")
    (folder / "2.csv").write_text("INV-100,2024-01-02,C-1,Alpha,,,30\n" + "".join(f"{1000 + i},,,Item {i} with a long name,1,10,10\n" for i in range(50)))
    (folder / "3.csv").write_text("INV-200,2024-01-03,C-2,Beta,,,7\n1000,,,Last item of all,1,7,7\n")
    df = ledger.report(spark, str(folder))
    assert len(df.columns) == 8
    out = ledger.flatten(df, ledger.Layout(doc=0, date=1, code=2, name=3, desc=3, total=6, seq=0, qty=4, price=5, amount=6)).orderBy("_ord").collect()
    assert [r.doc_no for r in out] == ["INV-100"] * 50 + ["INV-200"]
