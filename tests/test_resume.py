"""A writer that is stopped half-way and started again gives what an uncut one gives, each row once."""

import json

import pytest
from pyspark.sql import functions as F

from portcullis.streaming import resume

KIND = "source_index long, prediction string"


def _predict(batch):
    return batch.select("source_index", F.concat(F.lit("SELECT "), F.col("question")).alias("prediction"))


@pytest.fixture
def cases(spark, tmp_path):
    folder = tmp_path / "cases"
    folder.mkdir()
    for f in range(5):
        (folder / f"{f}.json").write_text("".join(json.dumps({"source_index": f * 10 + i, "question": f"q{f}{i}"}) + "\n" for i in range(10)))
    return spark.readStream.schema("source_index long, question string").option("maxFilesPerTrigger", 1).json(str(folder))


WANT = sorted((f * 10 + i, f"SELECT q{f}{i}") for f in range(5) for i in range(10))


def _rows(log):
    return sorted(map(tuple, log.committed().collect()))


def test_cut_and_restarted(spark, tmp_path, cases):
    log, calls = resume.PredictionLog(spark, str(tmp_path / "log"), KIND), []

    def failing(batch):
        calls.append(1)
        if len(calls) == 3:
            # half of the batch is written when the run dies
            _predict(batch.where("source_index % 2 = 0")).write.mode("overwrite").json(str(tmp_path / "log" / "run=a" / "batch=2"))
            (tmp_path / "log" / "run=a" / "batch=2" / "_SUCCESS").unlink()
            raise RuntimeError("lost")
        return _predict(batch)

    with pytest.raises(Exception, match="lost"):
        log.stream(cases, failing, "a", str(tmp_path / "point")).awaitTermination()
    assert len(_rows(log)) == 20
    log.stream(cases, _predict, "a", str(tmp_path / "point")).awaitTermination()
    assert _rows(log) == WANT and len(log.batches()) == 5


def test_new_run_without_the_checkpoint(spark, tmp_path, cases):
    log = resume.PredictionLog(spark, str(tmp_path / "log"), KIND)
    asked = []
    some = spark.createDataFrame([(i, f"q{i // 10}{i % 10}") for i in (3, 14, 15, 44)] + [(3, "again"), (None, "no key")], "source_index long, question string")
    log.commit(some, _predict, "first", 0)
    log.commit(some, _predict, "first", 0)  # replaced, not added
    assert len(_rows(log)) == 4
    log.stream(cases, lambda b: asked.append(b.count()) or _predict(b), "second", str(tmp_path / "other")).awaitTermination()
    assert _rows(log) == WANT and sum(asked) == 46
    assert [r.source_index for r in log.ordered().collect()] == list(range(50))
    assert log.pending(some).count() == 1


def test_empty_log_and_wrong_key(spark, tmp_path):
    log = resume.PredictionLog(spark, str(tmp_path / "nothing"), KIND)
    assert log.committed().count() == 0 and log.batches() == []
    with pytest.raises(ValueError, match="no column"):
        resume.PredictionLog(spark, str(tmp_path), KIND, key="id")


@pytest.mark.parametrize("size", [1, 7, 50, 1000])
def test_batches(spark, size):
    rows = spark.range(95).select((F.col("id") * 3 % 95).alias("source_index"), F.lit(1).alias("batch_of")).unionByName(spark.createDataFrame([(None, 2), (None, 2)], "source_index long, batch_of int"))
    got = resume.batches_of(rows, size).collect()
    want = sorted((r.source_index if r.source_index is not None else -1 for r in got))
    assert len(got) == 97 and sorted((r.batch, r.source_index if r.source_index is not None else -1) for r in got) == [(i // size, x) for i, x in enumerate(want)]
