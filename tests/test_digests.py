"""Canonical digests, and cached results bound to exact cases."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from portcullis.functions import digests
from portcullis.operators import evaluation as ev

TEXTS = [
    '{"b": 1, "a": {"z": [1, 2.50, 1.0, -0.0, 1e5, 1E-7, 12345678901234567890, true, null], "B": "é漢\\u001f\\n\\"\\\\/\\u007f"}, "": ""}', "[]", '"x"', '{"k": "\\ud83d\\ude42", "a b": {"y": 1, "x": {"2": 2, "10": 1}}}', " { } ",
    '{"t": "version 1.5 e", "u": "\\t\\b\\f\\r"}', "null", "12", '{"A": 1, "a": 2, "_": 3, "é": 4}',
]


def _canonical(text):
    return json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def test_canonical_text(spark):
    df = spark.createDataFrame([*enumerate(TEXTS), (-1, None)], "i int, t string").repartition(3)
    got = {r.i: (r.c, r.d) for r in df.select("i", digests.canonical_json(F.col("t")).alias("c"), digests.digest(F.col("t")).alias("d")).collect()}
    assert got == {-1: (None, None)} | {i: (_canonical(t), hashlib.sha256(_canonical(t).encode()).hexdigest()) for i, t in enumerate(TEXTS)}
    with pytest.raises(Exception, match="JSON|json"):
        spark.createDataFrame([("{",)], "t string").select(digests.canonical_json(F.col("t"))).collect()


def test_results_are_bound_to_exact_cases(spark):
    rows = spark.createDataFrame([(0, '{"gold_sql": "SELECT x FROM t", "allowed": true}')], "source_index long, record string")
    said = lambda text: spark.createDataFrame([(0, text)], "source_index long, prediction string")
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    case = (0, sha('{"allowed":true,"gold_sql":"SELECT x FROM t"}'), sha("SELECT x FROM t"), sha("SELECT x FROM t"), True)
    cache = lambda *found: spark.createDataFrame(list(found), "source_index long, row_sha256 string, prediction_sha256 string, gold_sql_sha256 string, execution_correct boolean")
    bound = ev.bindings(rows, said("SELECT x FROM t"))
    assert [tuple(r) for r in ev.bound_results(cache(case), bound).collect()] == [(0, True)]
    for wrong, why in (((case,), "prediction"), ((case, case), "repeated"), (((7, *case[1:]),), "out of range"), (((None, *case[1:]),), "out of range"), (((0, None, *case[2:]),), "row_sha256")):
        with pytest.raises(ValueError, match=why):
            ev.bound_results(cache(*wrong), ev.bindings(rows, said("SELECT y FROM t")) if why == "prediction" else bound)


@pytest.mark.parametrize(("record", "want"), [('{"gold_sql": "", "metadata": {"gold_sql": "b"}, "output": "c"}', "b"), ('{"gold_sql": "a", "output": "c"}', "a"), ('{"metadata": null, "output": "c"}', "c"), ("{}", "")])
def test_gold_goes_by_the_first_name_that_is_not_empty(spark, record, want):
    assert spark.createDataFrame([(record,)], "r string").select(digests.canonical_gold(F.col("r"))).first()[0] == want
