"""Sources that are missing, empty or odd."""

import json

import pytest
from pyspark.sql import functions as F

from lodestar.functions.arrays import removed
from lodestar.sources import files, records


def test_a_missing_table_is_no_empty_one(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, v string").schema
    for read in (lambda: records.read_latest(spark, str(tmp_path / "none"), schema, "k"), lambda: records.read_snapshot(spark, str(tmp_path / "none"), schema)):
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            read().count()
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "a.json").write_text("")
    assert records.read_latest(spark, str(tmp_path / "empty"), schema, "k").count() == 0


def test_snapshots_and_lines(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, v string").schema
    snapshot, lines = tmp_path / "s.json", tmp_path / "lines"
    snapshot.write_text(json.dumps([{"k": 1, "v": "a"}, {"k": 2, "v": None, "other": 1}], indent=1))
    assert sorted(map(tuple, records.read_snapshot(spark, str(snapshot), schema).collect())) == [(1, "a"), (2, None)]
    lines.mkdir()
    (lines / "1.json").write_text('{"k": 1, "v": "old"}\nno json\n{"k": 2, "v": "b"}\n')
    (lines / "2.json").write_text('{"v": "no key"}\n{"k": 1, "v": "new"}\n')
    assert sorted(map(tuple, records.read_latest(spark, str(lines), schema, "k").collect())) == [(1, "new"), (2, "b")]
    assert sorted(map(tuple, records.read_latest(spark, str(lines), schema, "k", newest_first=True).collect())) == [(1, "old"), (2, "b")]


def test_values_removed_from_arrays(spark):
    rows = [(["a", "b", "a", None], ["b"]), ([], []), (None, None), (["a"], [])]
    got = spark.createDataFrame(rows, "x array<string>, want array<string>").select(removed(F.col("x"), "a", "c").alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_files_that_cannot_be_read_have_no_cells(spark):
    df = spark.createDataFrame([(1, bytearray(b"PK broken")), (2, bytearray(b"")), (3, None)], "id long, content binary")
    assert files.cells_of(df, "id", "content", files.sheet_cells).count() == 0
    assert [r.text for r in files.texts_of(df, "id", "content").collect()] == [None] * 3
