"""JSON arrays in splits, and numbers over many files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from portcullis.sources import arrays, records, sinks


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def _value(r, deep=0):
    kind = r.random()
    if kind < 0.5 or deep > 2:
        return "".join(r.choice(['"', "\\", "{", "}", "[", "]", ",", "é", "漢", "\n", "\u001f", "x", "}}", '\\"', " "]) for _ in range(r.randint(0, 12)))
    if kind < 0.75:
        return {_value(r, 9): _value(r, deep + 1) for _ in range(r.randint(0, 3))}
    return [_value(r, deep + 1) for _ in range(r.randint(0, 3))]


@pytest.mark.parametrize("indent", [None, 2])
def test_records_lie_anywhere(spark, tmp_path, small_splits, indent):
    r = random.Random(9)
    want = []
    for part in (0, 1, 2, 10):
        rows = [{"k": i, "v": _value(r), "w": {"a": [{}, {"}": "{"}]}} for i in range([30, 0, 1, 25][part % 7])]
        want += rows
        (tmp_path / f"part-{part}.json").write_text(("﻿" if part == 2 else "") + json.dumps(rows, ensure_ascii=part % 2 == 0, indent=indent), encoding="utf-8")
    (tmp_path / "part-11.json").write_text("")
    (tmp_path / "part-12.json").write_text(" [ ]\n")
    got = arrays.read_array(spark, str(tmp_path)).collect()
    assert [json.loads(x.record) for x in sorted(got, key=lambda x: x.source_index)] == want
    assert sorted(x.source_index for x in got) == list(range(len(want)))
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 10


def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_splits):
    rows = [{"db_id": "d", "input": 'q "{" ' * 3, "gold_sql": None, "allowed": i % 2 == 0, "policy": "{}"} for i in range(200)]
    path = tmp_path / "rows.json"
    path.write_text(json.dumps(rows))
    read = records.read_records(spark, str(path))
    assert [(x.source_index, x.input, x.allowed) for x in read.orderBy("source_index").collect()] == [(i, y["input"], y["allowed"]) for i, y in enumerate(rows)]


@pytest.mark.parametrize("text", ['{"a": 1}', "[1, 2, {}]", '"x"', '[{"a": 1}, "b", {"a": 2}]'])
def test_anything_else_is_an_error(spark, tmp_path, text):
    path = tmp_path / "x.json"
    path.write_text(text)
    with pytest.raises(Exception, match="expected"):
        arrays.read_array(spark, str(path)).collect()


def test_scan_composes():
    r = random.Random(2)
    for _ in range(300):
        text = "".join(r.choice('"\\{}[]a') for _ in range(r.randint(0, 30)))
        cut = r.randint(0, len(text))
        for state in (arrays.OUTSIDE, arrays.INSIDE, arrays.ESCAPED):
            assert arrays.scan(text[cut:], *arrays.scan(text[:cut], state, 0)) == arrays.scan(text, state, 0)


@pytest.mark.parametrize("files", [1, 3, 12])
def test_predictions_of_many_files_keep_their_numbers(spark, tmp_path, small_splits, files):
    rows = spark.range(60).select(F.col("id").alias("source_index"), F.when(F.col("id") % 7 == 0, "").otherwise(F.concat(F.lit("SELECT "), F.col("id"))).alias("prediction"))
    spark.conf.set("spark.sql.shuffle.partitions", str(files))
    try:
        sinks.write_predictions(rows, str(tmp_path / "p.sql"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = records.read_predictions(spark, str(tmp_path / "p.sql")).orderBy("source_index").collect()
    assert [(x.source_index, x.prediction) for x in got] == [(x.source_index, x.prediction) for x in rows.collect()]
