"""Denotation equality against trying all orders of columns."""

import random
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from portcullis import queries_execution
from portcullis.operators import denotation as dn


def brute(gold, predicted, ordered):
    if not gold and not predicted:
        return True
    if len(gold) != len(predicted) or len(gold[0]) != len(predicted[0]):
        return False
    for p in permutations(range(len(gold[0]))):
        other = [tuple(r[i] for i in p) for r in predicted]
        if (gold == other) if ordered else (Counter(gold) == Counter(other)):
            return True
    return False


def judged(spark, cases):
    rows = [(i, side, n if ordered else None, ["" if x is None else f"n:{x}" for x in r]) for i, (g, p, ordered) in enumerate(cases) for side, t in ((True, g), (False, p)) for n, r in enumerate(t)]
    table = spark.createDataFrame(rows, "case_id int, gold boolean, place long, cells array<string>").repartition(3)
    got = dn.denotation_equal(table, spark.range(len(cases)).select(F.col("id").cast("int").alias("case_id")))
    return {r.case_id: r.matches for r in got.collect()}


def shuffled(r, table, order, ordered):
    out = [tuple(row[i] for i in order) for row in table]
    if not ordered:
        r.shuffle(out)
    return out


def test_against_all_orders(spark):
    r = random.Random(4)
    cases = []
    for _ in range(250):
        width, height, kinds, ordered = r.randint(1, 5), r.randint(0, 5), r.choice([1, 2, 2, 3, 9]), r.random() < 0.4
        gold = [tuple(r.choice([*range(kinds), None]) for _ in range(width)) for _ in range(height)]
        other = shuffled(r, gold, r.sample(range(width), width), ordered)
        if height and r.random() < 0.5:
            i, row = r.randrange(height), list(other[0])
            row = list(other[i])
            row[r.randrange(width)] = r.randrange(kinds)
            other[i] = tuple(row)
        if r.random() < 0.1 and other:
            other = other[1:] if r.random() < 0.5 else [row[1:] for row in other if len(row) > 1] or other
        cases.append((gold, other, ordered))
    got = judged(spark, cases)
    want = {i: brute(*c) for i, c in enumerate(cases)}
    assert got == want
    assert 60 < sum(want.values()) < 200


def graph(edges, n):
    return [tuple(int((a, b) in edges or (b, a) in edges) for b in range(n)) for a in range(n)]


def test_columns_that_refinement_cannot_tell_apart(spark):
    """Unit and adjacency matrices: all columns have one colour."""
    r = random.Random(8)
    ring = lambda ns: {(a, b) for a, b in zip(ns, ns[1:] + ns[:1], strict=True)}
    unit = [tuple(int(a == b) for b in range(7)) for a in range(7)]
    six, two_threes = graph(ring(list(range(6))), 6), graph(ring([0, 1, 2]) | ring([3, 4, 5]), 6)
    mixed = lambda t: shuffled(r, t, r.sample(range(len(t[0])), len(t[0])), False)
    cases = [(unit, mixed(unit), False), (six, mixed(six), False), (two_threes, mixed(two_threes), False), (six, two_threes, False), (two_threes, six, False), ([x + x for x in six], mixed([x + x for x in six]), False)]
    assert judged(spark, cases[:5]) == {0: True, 1: True, 2: True, **{i: brute(*cases[i]) for i in (3, 4)}}
    assert judged(spark, cases[5:]) == {0: True}


def test_empty_results_match_whatever_their_columns(spark):
    assert judged(spark, [([], [], False), ([(1,)], [], False), ([], [(1, 2)], True)]) == {0: True, 1: False, 2: False}


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("1", "1.0D", True), ("1", "CAST(1.00 AS DECIMAL(9,2))", True), ("1", "TRUE", True), ("1", "'1'", False), ("NULL", "CAST(NULL AS STRING)", True), ("''", "NULL", False), ("CAST(1.5 AS DECIMAL(5,2))", "1.5D", True), ("-0.0D", "0", True),
        ("9007199254740993L", "9007199254740992.0D", False), ("DATE'2020-01-02'", "'2020-01-02'", True), ("CAST(5 AS TINYINT)", "5L", True), ("0.1D", "CAST(0.1 AS DECIMAL(3,1))", True), ("array(1, 2)", "array(1, 2)", True), ("1e300D", "1e300D", True), ("X'41'", "'A'", False),
    ],
)
def test_values_compare_over_types(spark, a, b, same):
    x, y = (dn.result_rows(spark.sql(f"SELECT {v} AS v"), False).first().cells for v in (a, b))
    assert (x == y) is same


def test_places(spark):
    df = spark.range(40).repartition(7).orderBy(F.desc("id"))
    rows = dn.result_rows(df, True).withColumn("k", F.lit(1))
    got = dn.ranked_places(rows, "k").orderBy("place").collect()
    assert [(r.place, r.cells) for r in got] == [(i, [f"n:{39 - i}"]) for i in range(40)]


def test_large_cases_are_summed_by_task(spark, monkeypatch):
    monkeypatch.setattr(dn, "LARGE", 6)
    gold = [(i % 3, i, 7) for i in range(9)]
    turned = [(r[2], r[0], r[1]) for r in reversed(gold)]
    cases = [(gold, turned, False), (gold, [*turned[1:], (7, 0, 99)], False), (gold[:2], turned[-2:], False), (gold[:2], turned[:2], False), (gold, turned[:-1], False), (gold, turned, True), (gold, turned[::-1], True)]
    assert judged(spark, cases) == {i: brute(*c) for i, c in enumerate(cases)}


def test_first_colours_shuffle_rows_once_and_no_cells(spark):
    rows = spark.range(20).select((F.col("id") % 4).alias("case_id"), (F.col("id") % 2 == 0).alias("gold"), F.lit(None).cast("long").alias("place"), F.array(F.lit("n:1"), F.lit("n:2")).alias("cells"), F.col("id").alias("_row"))
    plan = dn._first(rows.repartition("case_id"))._jdf.queryExecution().sparkPlan().toString()
    done = dn._first(rows.repartition("case_id"))._jdf.queryExecution().executedPlan().toString()
    assert "Generate posexplode" in plan and done.count("Exchange hashpartitioning") == 1


def test_rows_are_shuffled_once_and_not_written(spark, sf_dir, monkeypatch):
    """No table with cells is written, and what deals the rows by case serves the colours and the comparison."""
    made, written = [], dn.steps.written

    def seen(df, *args):
        df.collect()
        made.append((df.columns, df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]))
        return written(df, *args)

    monkeypatch.setattr(dn.steps, "written", seen)
    assert queries_execution.denotation_equal(spark, sf_dir).count() == 200
    assert not any("cells" in columns for columns, _ in made)
    plan = next(plan for columns, plan in made if columns == ["case_id", "open", "good"])
    assert plan.count("ReusedExchange") == 1 and plan.count("Exchange hashpartitioning") == 2  # the one, and where it is read again


@pytest.mark.parametrize("dealt", [False, True])
def test_open_large_and_null_cases_together(spark, monkeypatch, dealt):
    monkeypatch.setattr(dn, "LARGE", 10)
    ring = graph({(0, 1), (1, 2), (2, 3), (3, 0)}, 4)
    big = [(i % 3, i, 7) for i in range(9)]
    cases = {1: (ring, ring[::-1]), 2: (big, [(c, a, b) for a, b, c in big]), 3: (big, [(c, a, a) for a, b, c in big]), 4: ([(1, 2)], [(2, 1)]), 5: ([(1, 2)], [(2, 2)]), None: ([(1,)], [(2,)])}
    rows = [(case, side, None, [f"n:{x}" for x in r]) for case, both in cases.items() for side, t in zip((True, False), both, strict=True) for r in t]
    table = spark.createDataFrame(rows, "case_id int, gold boolean, place long, cells array<string>")
    table = table.repartition(1) if dealt else table.repartition(3)
    got = dn.denotation_equal(table, spark.createDataFrame([(c,) for c in [*cases, 6]], "case_id int"), dealt=dealt)
    assert {r.case_id: r.matches for r in got.collect()} == {1: True, 2: True, 3: False, 4: True, 5: False, None: True, 6: True}
