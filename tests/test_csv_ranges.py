"""CSV files read in byte ranges: line breaks and quotes in cells against a parser that takes the file as one piece."""
import csv
import io
import random

import pytest

from ledgerlens.session import scratch_path, stored
from ledgerlens.sources import csv_ranges
from ledgerlens.sources import tables as TB
from ledgerlens.sources.csv_ranges import csv_records, ends_inside


@pytest.fixture(params=[23, 200])
def ranged(spark, request, monkeypatch):
    """The text is read in ranges of so many bytes, so that many of them start inside quoted cells."""
    def small(df, name):
        if name != "csv-lines":
            return stored(df, name)
        old = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
        try:
            df.write.parquet(path := scratch_path(spark, name))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        return spark.read.schema(df.schema).parquet(path).coalesce(4)

    monkeypatch.setattr(csv_ranges, "stored", small)
    return spark


def _cells(rng, n):
    parts = ["a", "b c", '"', ",", "\n", "\n\n", '""', "é", "x" * 30, '","', '"\n"']
    return [["k%d" % i, *["t" + "".join(rng.choice(parts) for _ in range(rng.randrange(6))) for _ in range(3)]] for i in range(n)]


def _written(rows, end="\r\n"):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("seed", [1, 2])
def test_random_cells_come_back(ranged, tmp_path, seed):
    rows = _cells(random.Random(seed), 60)
    path = tmp_path / "r.csv"
    path.write_bytes(_written([["id", "a", "b", "c"], *rows], "\n" if seed == 1 else "\r\n").encode())
    got = TB.read_csv(ranged, str(path))
    assert got.columns == ["id", "a", "b", "c"]
    assert sorted(map(list, got.collect())) == sorted(rows)


def test_quotes_inside_unquoted_cells_open_nothing(ranged, tmp_path):
    text = 'id,size,note\n1,5" pipe,plain\n2,3",end"\n3,"two\nlines",6"\n4,x,"a ""b"""\n'
    (tmp_path / "q.csv").write_text(text)
    got = sorted(tuple(r) for r in TB.read_csv(ranged, str(tmp_path / "q.csv")).collect())
    assert got == [(1, '5" pipe', "plain"), (2, '3"', 'end"'), (3, "two\nlines", '6"'), (4, "x", 'a "b"')]


def test_many_files_their_headers_blank_lines_and_encodings(ranged, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "a.csv").write_bytes('\n"na\nme",n\n\n"José\n\nx",1\n \nAnn,2\n'.encode())
    (folder / "b.csv").write_bytes('"na\nme",n\n"Jos\xe9",3\n'.encode("latin-1"))
    (folder / "c.csv").write_bytes(b"")
    got = TB.read_csv(ranged, str(folder))
    assert sorted(tuple(r) for r in got.collect()) == [("Ann", 2), ("José", 3), ("José\n\nx", 1)]


def test_a_cell_over_many_ranges(ranged, tmp_path):
    cell = "\n".join(f"line {i}, \"{i}\"" for i in range(300))
    (tmp_path / "l.csv").write_text(_written([["id", "t"], ["1", cell], ["2", "end"]], "\n"))
    assert sorted(tuple(r) for r in TB.read_csv(ranged, str(tmp_path / "l.csv")).collect()) == [(1, cell), (2, "end")]


def test_open_quotes_empty_files_and_lone_carriage_returns(spark, tmp_path):
    (tmp_path / "o.csv").write_text('a,b\n1,"open\n2,3\n')
    with pytest.raises(ValueError):
        TB.read_csv(spark, str(tmp_path / "o.csv"))
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(ValueError):
        TB.read_csv(spark, str(tmp_path / "e.csv"))
    (tmp_path / "h.csv").write_text("a,b\n")
    assert TB.read_csv(spark, str(tmp_path / "h.csv")).count() == 0
    (tmp_path / "m.csv").write_bytes(b"a,b\r1,x\r2,y\r")
    assert csv_records(spark, str(tmp_path / "m.csv")) is None
    assert sorted(tuple(r) for r in TB.read_csv(spark, str(tmp_path / "m.csv")).collect()) == [(1, "x"), (2, "y")]


def test_line_states():
    assert not ends_inside(b'a,"b",c', False) and ends_inside(b'a,"b', False) and ends_inside(b'a,"b""', False)
    assert not ends_inside(b'x",y', True) and ends_inside(b'x",y', True) is False and ends_inside(b'x","y', True)
    assert not ends_inside(b'5" pipe,3"', False) and ends_inside(b"", True) and not ends_inside(b"", False)
