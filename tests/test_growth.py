"""Steps whose work must not grow with the square of their input."""

import itertools
import random

from pyspark.sql import functions as F

from portcullis.functions import text
from portcullis.operators import access, bitsets, overlap, quality


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dataset_labels_over_blocks_of_roles(spark):
    """Roles of two blocks, as a loop over cases and roles labels them; and no exchange after cases meet roles."""
    n = access.ROLE_BLOCK + 76
    held = [("d", f"r{i:05}", *g) for i in range(n) for g in [("SELECT", "T", "*" if i % 3 == 0 else "a"), ("INSERT", "t", None)][: 1 + i % 2]] + [("d", None, "SELECT", "t", "a"), ("e", "x", "DDL", None, None)]
    asked = [(1, "d", "SELECT", "read", "t", "a"), (1, "d", "SELECT", "read", "t", "b"), (2, "d", "SELECT", "insert", "T", ""), (2, "d", "SELECT", "read", "T", "b"), (3, "d", "SELECT", "read", "own", "z"), (4, "e", "SELECT", "ddl", "", ""), (None, "d", "SELECT", "read", "t", "b")]
    policies = spark.createDataFrame(held, "db_id string, role string, operation string, table_name string, column_name string")
    required = spark.createDataFrame(asked, "case_id long, db_id string, operation string, kind string, table_name string, column_name string")
    df = access.dataset_labels(required, policies, spark.createDataFrame([("d", "t")], "db_id string, table_name string"))
    want = [(4, "e", "x", True, None)]
    for role in {r for d, r, *_ in held if d == "d"}:
        grants = {(o, (t or "").lower(), c if o == "SELECT" else "*") for _, r, o, t, c in held if r == role}
        covered = lambda o, c, g=grants: (o, "t", "*") in g or (o, "t", c) in g
        read = None if role is None or covered("SELECT", "a") and covered("SELECT", "b") else "read_not_allowed"
        insert = None if role is None or covered("INSERT", "") else "insert_not_allowed"
        for case, why in ((1, read), (2, insert or read), (3, None), (None, None)):
            want.append((case, "d", role, why is None, why))
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)
    plan = _plan(df)
    assert "Generate explode" in plan and plan.index("Generate explode") < plan.index("Exchange")


def _brute(sets, digits=6):
    """pairs, mean and greatest overlap and the first pair of the greatest; a null member equals no other."""
    out = []
    for (a, x), (b, y) in itertools.combinations(sorted(sets.items()), 2):
        both = len({m for m in x & y if None not in m})
        out.append((round(both / (len(x) + len(y) - both), digits), a, b))
    o, a, b = min((-o, a, b) for o, a, b in out)
    return len(out), round(sum(x[0] for x in out) / len(out), 3), -o, a, b


def test_policy_overlap_by_blocks(spark, monkeypatch):
    """All pairs of roles by a loop, over many blocks, with copies, null names and roles that share nothing; no join of roles with roles."""
    monkeypatch.setattr(overlap, "BLOCK_SETS", 5)
    rng = random.Random(7)
    sets = {i: {(rng.choice("tuv"), str(rng.randrange(60))) for _ in range(rng.randrange(1, 30))} for i in range(40)}
    sets |= {40: sets[3], 41: sets[3], 42: {("t", None), ("t", "1")}, 43: {("t", None), ("t", "1")}, 44: {("z", "alone")}}
    alone = {1: {("t", "1")}, 2: {("t", "2")}, 3: {("t", "3")}}
    rows = [(d, r, *m) for d, s in ((1, sets), (2, alone), (3, {9: sets[0]})) for r, ms in s.items() for m in ms]
    df = spark.createDataFrame(rows, "db_id int, role_ord long, table_name string, column_name string")
    got = {r.db_id: (r.pairs, round(r.avg_overlap, 3), r.max_overlap, r.role_a, r.role_b) for r in quality.policy_overlap(df).collect()}
    assert got == {1: _brute(sets), 2: (3, 0.0, 0.0, 1, 2)}
    del sets[40], sets[41]
    df = df.where("role_ord not in (40, 41)")
    assert tuple(quality.policy_overlap(df).where("db_id = 1").collect()[0])[3:] == _brute(sets)[2:]


def test_permission_overlaps_by_blocks(spark, monkeypatch):
    """Roles' permission sets over many blocks as a loop compares them; no column's holders are gathered in one row."""
    monkeypatch.setattr(overlap, "BLOCK_SETS", 4)
    rng = random.Random(3)
    sets = {f"r{i:02}": {(rng.choice(["SELECT", "UPDATE"]), "t", f"c{rng.randrange(150)}") for _ in range(rng.randrange(1, 40))} | ({("DDL", "", "")} if i % 4 == 0 else set()) for i in range(30)}
    sets["r30"] = sets["r07"]
    rows = [(1, r, o, t or None, c or None) for r, ms in sets.items() for o, t, c in ms] + [(1, "SystemManager", "SELECT", "t", "c1"), (1, "An Admin", "SELECT", "t", "c1")]
    policies = spark.createDataFrame(rows, "db_id int, role string, operation string, table_name string, column_name string")
    schema = spark.createDataFrame([(1, "t", f"c{i}") for i in range(70)], "db_id int, table_name string, column_name string")
    got = bitsets.overlaps(policies, schema).collect()[0]
    assert (got.pairs, round(got.avg_overlap, 3), got.max_overlap, got.role_a, got.role_b) == _brute(sets)
    assert "collect_set" not in _plan(bitsets.permission_words(policies, schema))


def test_cloud_sql_reads_an_answer_once(spark):
    """An answer is cut at its fences once, not once for each use of what is found."""
    df = spark.createDataFrame([("Here: ```sql\nSELECT a FROM t; thanks\n```",), (None,)], "t string").select(text.cloud_sql(F.col("t")).alias("c"))
    assert df._jdf.queryExecution().analyzed().toString().count("split(") <= 3  # fences, their number, lines
    assert [r.c for r in df.collect()] == ["SELECT a FROM t;", text.REFUSAL_TEXT]


def test_dataset_labels_works_reasons_out_once_a_set(spark, monkeypatch):
    """Kinds that lack together, cases of one set shared out, and no bits put together after cases met their sets."""
    monkeypatch.setattr(access, "SHARE", 3, raising=False)
    rng = random.Random(5)
    kinds = list(access.DATASET_NEEDS)
    held = [("d", f"r{i}", rng.choice(["SELECT", "UPDATE", "INSERT", "DELETE", "DDL"]), rng.choice("TU"), rng.choice("ab*")) for i in range(40) for _ in range(4)]
    held = [(d, r, o, *((None, None) if o == "DDL" else g)) for d, r, o, *g in held]
    forms = [[(rng.choice(kinds), rng.choice("tuv"), rng.choice(["a", "b", ""])) for _ in range(rng.randrange(5))] for _ in range(12)]
    asked = [(n, "d", "UPDATE", *need) for n in range(60) for need in forms[n % 12] or [("none", "", "")]]
    policies = spark.createDataFrame(held, "db_id string, role string, operation string, table_name string, column_name string")
    required = spark.createDataFrame(asked, "case_id long, db_id string, operation string, kind string, table_name string, column_name string")
    df = access.dataset_labels(required, policies, spark.createDataFrame([("d", "T")], "db_id string, table_name string"))
    want = []
    for role in {r for _, r, *_ in held}:
        mine = [(o, (t or "").lower(), c) for _, r, o, t, c in held if r == role]
        for n in range(60):
            lacks = []
            for kind, t, c in forms[n % 12]:
                op = access.DATASET_NEEDS[kind][0]
                known = kind == "ddl" or t == "t" or any(o != "DDL" and x == t for o, x, _ in mine)
                has = any(o == op and (op == "DDL" or x == t and (op in ("INSERT", "DELETE") or y == "*" or y == c)) for o, x, y in mine)
                lacks += [kinds.index(kind)] if known and not has else []
            why = access.DATASET_NEEDS[kinds[min(lacks)]][1] if lacks else None
            want.append((n, "d", role, why is None, why))
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)
    plan = _plan(df)
    assert "aggregate(" not in plan[: plan.index("Exchange")]
