"""CSV files whose cells hold line breaks, read in many splits."""

import csv
import io
import random

import pytest

from tablewright.sources.files import read_csv, split_records


def cells(draw):
    return draw.choice(
        ["plain", "", "a,b", 'say "hi"', "two\nlines", "\n\n", '"\n"', 'end"', "5\" pipe", "x" * 200, "a\r\nb", ' "lead', "é\n字", ",\n,", '""', "1"]
    )


def written(path, rows, end="\n"):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(["id", "text", "more"])
    writer.writerows(rows)
    path.write_bytes(out.getvalue().encode())


def rows_of(df):
    return sorted(((r["id"], r["text"] or "", r["more"] or "") for r in df.collect()), key=str)


@pytest.fixture
def tiny(spark):
    """Splits of a few hundred bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_split_files_give_the_rows_of_whole_ones(tiny, tmp_path, end):
    draw = random.Random(len(end))
    rows = []
    for part in range(3):
        own = [(part * 1000 + i, cells(draw), cells(draw)) for i in range(80)]
        written(tmp_path / f"p {part}.csv", own, end)
        rows += own
    got = read_csv(tiny, str(tmp_path))
    assert dict(got.dtypes) == {"id": "bigint", "text": "string", "more": "string"}
    assert rows_of(got) == sorted(rows, key=str)
    assert got.rdd.getNumPartitions() > 20


def test_one_cell_over_many_splits(tiny, tmp_path):
    rows = [(1, "a", "b"), (2, "\n".join(f'line {i} "q"' for i in range(400)), "x\ny"), (3, "c\nd", ""), (4, "\n" * 900, "end")]
    written(tmp_path / "long.csv", rows)
    assert split_records(tiny, str(tmp_path)).count() == 4
    assert rows_of(read_csv(tiny, str(tmp_path))) == sorted(rows, key=str)


def test_stray_quotes_and_types(tiny, tmp_path):
    text = 'id,text,more\n1,5" pipe,"a\nb"\n2,x"y"z,\n\n3,"""q""\n",2\n4,,"7"\n' * 1
    (tmp_path / "s.csv").write_text(text)
    got = read_csv(tiny, str(tmp_path))
    assert rows_of(got) == rows_of(read_csv(tiny, str(tmp_path), multi_line=True))
    numbers = "".join(f'{i},"n\n{i}",{i}.5\n' for i in range(100))
    (tmp_path / "s.csv").write_text("id,text,more\n" + numbers)
    assert dict(read_csv(tiny, str(tmp_path)).dtypes) == {"id": "bigint", "text": "string", "more": "double"}


def test_files_that_are_not_cut(tiny, tmp_path):
    (tmp_path / "h.csv").write_text('id,"te\nxt",more\n1,"a\nb",c\n')
    assert split_records(tiny, str(tmp_path)) is None
    assert read_csv(tiny, str(tmp_path)).columns == ["id", "te\nxt", "more"]
    (tmp_path / "h.csv").write_bytes(b'id,text,more\r1,"a\rb",c\r')
    assert split_records(tiny, str(tmp_path)) is None


def test_short_records_are_errors(tiny, tmp_path):
    (tmp_path / "e.csv").write_text('id,text,more\n1,"a\nb",c\n2,only\n')
    with pytest.raises(Exception):
        read_csv(tiny, str(tmp_path)).collect()


def test_names_with_signs_of_a_glob(tiny, tmp_path):
    (tmp_path / "y[1].csv").write_text("a,b\n1,x\n")
    (tmp_path / "z{2}*.csv").write_text("b,a\ny,2\n")
    assert sorted(map(tuple, read_csv(tiny, str(tmp_path)).select("a", "b").collect())) == [(1, "x"), (2, "y")]
