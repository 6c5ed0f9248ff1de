"""Delimited files in splits: other encodings, quoted line ends."""

import csv
import io

import pytest

from veldspar.sources import files


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def rows(n):
    texts = ["가나다", 'quote " in', "line\nend", "", "a,b\n\n\nc", "마지막\n", "plain", '"']
    return [(str(i), texts[i % len(texts)] + "값" * (i % 7), "x" if i % 3 else "two\nlines") for i in range(n)]


def written(folder, encoding, data, end="\n", files_=2):
    folder.mkdir()
    for k in range(files_):
        text = io.StringIO()
        out = csv.writer(text, quoting=csv.QUOTE_ALL, lineterminator=end)
        out.writerow(["번호", "글", "more"])
        out.writerows(data[k::files_])
        (folder / f"{k}.csv").write_bytes(text.getvalue().encode(encoding))
    return str(folder)


@pytest.mark.parametrize(("encoding", "end"), [("cp949", "\n"), ("UTF-16LE", "\r\n"), ("UTF-8", "\n")])
def test_quoted_line_ends_across_splits(spark, tmp_path, small_splits, encoding, end):
    data = rows(160)
    path = written(tmp_path / "a", encoding, data, end)
    assert spark.read.text(path).rdd.getNumPartitions() > 6
    got = files.load_delimited(spark, path, encoding=encoding, null="NA", multiline=True).collect()
    assert sorted((r["번호"], r["글"] or "", r["more"]) for r in got) == sorted(data)


def test_plain_lines_in_another_encoding_across_splits(spark, tmp_path, small_splits):
    data = [(str(i), f"값 {i % 5}", "번호") for i in range(300)] + [("번호", "글", "more")]  # one row like the header stays
    got = files.load_delimited(spark, written(tmp_path / "b", "cp949", data), encoding="cp949").collect()
    assert sorted(map(tuple, got)) == sorted(data)


def test_unclosed_quotes_raise(spark, tmp_path):
    (tmp_path / "c.csv").write_text('a,b\n1,"x\n' + "2,y\n" * 50)
    with pytest.raises(ValueError):
        files._records(files._lines(spark, str(tmp_path / "c.csv"), "UTF-8"), longest=100)
    with pytest.raises(ValueError):
        (tmp_path / "d.csv").write_text("")
        files.load_delimited(spark, str(tmp_path / "d.csv"), multiline=True)
