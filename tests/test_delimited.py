"""Files of several encodings and delimiters in one folder."""

import pytest

from tidegrain.operators.checks import DataRefused
from tidegrain.sources import delimited as S


def test_encodings_and_delimiters_of_bytes():
    text = "tên;giá\ncà phê;3\n"
    assert S.encoding_of(text.encode("utf-8-sig"))[0] == "utf-8-sig" and S.encoding_of(text.encode())[0] == "utf-8" and S.encoding_of(b"")[0] == "utf-8"
    assert S.encoding_of("ph\xea".encode("cp1252")) == ("cp1258", "ph\xea", False)  # both read alike
    assert S.encoding_of(b"\xcc a")[:3] == ("cp1258", "̀ a", True) and S.encoding_of(b"\x8a")[0] == "cp1252" and S.encoding_of(b"\x8d")[0] is None
    assert S.delimiter_of("a,b;c,d\n1,2;3,4\n", "x.csv") == (",", 3) and S.delimiter_of("a;b\n1,5;2\n3;4,5\n", "x.csv") == (";", 2)
    assert S.delimiter_of('"a|b"|c\n"d\ne"|f\n', "x.txt") == ("|", 2) and S.delimiter_of("word\n", "x.tsv") == ("\t", 1) and S.delimiter_of("", "x.csv") == (",", 1)


@pytest.fixture()
def folder(tmp_path):
    files = {
        "a.csv": "tên,giá\ncà phê,3\n".encode("utf-8-sig"),
        "b.csv": 'tên;ghi chú\ntrà;"hai\ndòng; ""mới"""\n;\n'.encode(),
        "c.tsv": "name\tprice\nph\xea\t1,5\n".encode("cp1258"),
        "d.txt": b"name|x\n\x8aabc|2|3\n",
        "empty.csv": b"",
        "skip.json": b"{}",
    }
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    return tmp_path


def test_one_folder_of_several_kinds(spark, folder):
    found = S.describe(spark, str(folder))
    kinds = {r.path.rsplit("/", 1)[1]: (r.encoding, r.delimiter, r.n_columns, r.ambiguous) for r in found.collect()}
    assert kinds == {"a.csv": ("utf-8-sig", ",", 2, False), "b.csv": ("utf-8", ";", 2, False), "c.tsv": ("cp1258", "\t", 2, False), "d.txt": ("cp1252", "|", 3, False)}
    rows = {}
    for r in S.read_rows(spark, found).orderBy("path", "row").collect():
        rows.setdefault(r.path.rsplit("/", 1)[1], []).append((r.row, r.fields))
    assert rows["a.csv"] == [(1, ["tên", "giá"]), (2, ["cà phê", "3"])]
    assert rows["b.csv"] == [(1, ["tên", "ghi chú"]), (2, ["trà", 'hai\ndòng; "mới"']), (3, [None, None])]
    assert rows["c.tsv"] == [(1, ["name", "price"]), (2, ["ph\xea", "1,5"])] and rows["d.txt"] == [(1, ["name", "x", None]), (2, ["Šabc", "2", "3"])]
    assert set(rows) == {"a.csv", "b.csv", "c.tsv", "d.txt"}


def test_refusals(spark, folder):
    with pytest.raises(DataRefused, match="TOO_MANY_COLUMNS"):
        S.read_rows(spark, S.describe(spark, str(folder)), most_columns=2)
    (folder / "e.csv").write_bytes(b"a,\x8d\n")
    with pytest.raises(DataRefused, match="ENCODING_UNDETERMINED"):
        S.read_rows(spark, S.describe(spark, str(folder)))
    (folder / "none").mkdir()
    assert S.read_rows(spark, S.describe(spark, str(folder), "*.none")).count() == 0
