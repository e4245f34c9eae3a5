"""Registered queries of statement execution and its comparisons, each with DuckDB SQL for the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import fixtures as fx
from . import steps
from .functions import scanning
from .operators import denotation as dn
from .operators import execution as ex
from .queries import _registered
from .sources import items, records
from .streaming import resume

#: Pairs of statements over the base tables: equal, with columns or rows in another order, with other rows, repeated rows or an order.
PAIRS = [
    ("SELECT n_name, n_regionkey FROM nation", "SELECT n_name, n_regionkey FROM nation WHERE n_nationkey > = 0"),
    ("SELECT n_regionkey, n_name FROM nation", "SELECT n_name, n_regionkey FROM nation"),
    ("SELECT n_name FROM nation WHERE n_regionkey = 1", "SELECT n_name FROM nation WHERE n_regionkey = 2"),
    ("SELECT n_regionkey FROM nation", "SELECT n_regionkey FROM nation GROUP BY n_regionkey"),
    ("SELECT n_name FROM nation ORDER BY n_name DESC", "SELECT n_name FROM nation ORDER BY n_name"),
    ("SELECT n_name FROM nation ORDER BY n_name", "SELECT n_name FROM nation ORDER BY n_name"),
    ("SELECT COUNT(*) AS n FROM orders", "SELECT COUNT(o_orderkey) AS n FROM orders"),
    ("SELECT o_custkey FROM orders WHERE o_orderkey < 0", "SELECT c_custkey FROM customer WHERE c_custkey < 0"),
]


def _numbered(sql: str) -> str:
    """The statement in DuckDB with cells in one order, and rows numbered where it sorts."""
    place = "ROW_NUMBER() OVER ()" if "ORDER BY" in sql else "0"
    inner = sql.replace("> =", ">=")
    return f"SELECT {place} AS place, LIST_SORT(LIST_VALUE({{cells}})) AS cells FROM ({inner}) AS q"


def _pair_sql(i: int, predicted: str, gold: str) -> str:
    columns = [[c.split(" AS ")[-1].strip() for c in s.split("SELECT ")[1].split(" FROM")[0].split(",")] for s in (predicted, gold)]
    p, g = (_numbered(s).format(cells=", ".join(f"CAST({c} AS VARCHAR)" for c in cs)) for s, cs in zip((predicted, gold), columns, strict=True))
    return f"SELECT {i} AS pair, NOT EXISTS ({p} EXCEPT ALL {g}) AND NOT EXISTS ({g} EXCEPT ALL {p}) AS matches"


@_registered("exec_match", " UNION ALL ".join(f"({_pair_sql(i, p, g)})" for i, (p, g) in enumerate(PAIRS)))
def exec_match(spark: SparkSession, d: str) -> DataFrame:
    session = ex.open_database(spark, {t: f"{d}/{t}.parquet" for t in ("nation", "orders", "customer")})
    verdicts = ex.exec_verdicts(spark, [ex.Pair((session,), p, g) for p, g in PAIRS])
    return spark.createDataFrame([(i, v == "match") for i, v in enumerate(verdicts)], "pair int, matches boolean")


#: Cells of a result's row, as SQL that both engines read; numbers of several types, one column twice, and text.
_CELLS = (
    "l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "CAST(l_quantity AS INT)",
    "l_linenumber + l_quantity", "CASE WHEN l_tax < 0.04 THEN NULL ELSE l_returnflag END",
)
#: What the prediction's result has of the gold's, by case_id % 8: a changed cell, rows lost, rows twice, two cells of one row exchanged, or all of it.
_LOST, _TWICE, _CHANGED, _EXCHANGED = "k % 8 = 1 AND l_linenumber = 1", "k % 8 = 2 AND l_linenumber = 2", "k % 8 = 3 AND l_linenumber = 1", "k % 8 = 4"


def _denotation_sql() -> str:
    """All rotations of the prediction's columns, each compared as a bag with the gold: one that is equal makes a match."""
    n = len(_CELLS)
    number = lambda c: f"COALESCE(CAST({c} AS VARCHAR), '')"
    shown = ", ".join(f"CAST({c} AS DOUBLE) AS g{i}" if "flag" not in c and "status" not in c else f"{c} AS g{i}" for i, c in enumerate(_CELLS))
    swapped = [f"CASE WHEN {_EXCHANGED} AND first THEN {{}} ELSE {number(f'g{i}')} END" for i in range(n)]
    cells = [swapped[i].format(number("g4") if i == 3 else number("g3")) if i in (3, 4) else number(f"g{i}") for i in range(n)]
    cells[0] = f"CASE WHEN {_CHANGED} THEN '-1.0' ELSE {cells[0]} END"
    orders = " UNION ALL ".join(f"SELECT k, {r} AS r, CONCAT_WS('|', {', '.join(f'p{(i + r) % n}' for i in range(n))}) AS t FROM q" for r in range(n))
    return f"""WITH l AS (SELECT l_partkey AS k, l_linenumber, {shown}, ROW_NUMBER() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) = 1 AS first FROM lineitem),
 g AS (SELECT k, LIST_SORT(LIST(CONCAT_WS('|', {", ".join(number(f"g{i}") for i in range(n))}))) AS rows FROM l GROUP BY k),
 q AS (SELECT k, {", ".join(f"{c} AS p{i}" for i, c in enumerate(cells))} FROM (SELECT * FROM l UNION ALL SELECT * FROM l WHERE {_TWICE}) AS t WHERE NOT ({_LOST})), o AS ({orders}), b AS (SELECT k, r, LIST_SORT(LIST(t)) AS rows FROM o GROUP BY k, r),
 m AS (SELECT DISTINCT g.k FROM g JOIN b ON g.k = b.k AND g.rows = b.rows)
 SELECT c.k AS case_id, m.k IS NOT NULL OR g.k IS NULL AS matches FROM (SELECT p_partkey AS k FROM part) AS c LEFT JOIN g ON c.k = g.k LEFT JOIN m ON c.k = m.k"""


@_registered("denotation_equal", _denotation_sql())
def denotation_equal(spark: SparkSession, d: str) -> DataFrame:
    """A case for each part: its rows of lineitem against them with turned columns and, in half of the cases, something else changed."""
    rows = fx.table(spark, d, "lineitem").withColumn("k", F.col("l_partkey"))
    width = len(_CELLS)
    first = F.row_number().over(Window.partitionBy("k").orderBy("l_orderkey", "l_linenumber")) == 1
    typed = rows.withColumn("first", first).select("k", "l_linenumber", "first", *[F.expr(c).alias(f"g{i}") for i, c in enumerate(_CELLS)])
    cell = [dn.normal_cell(F.col(f.name), f.dataType) for f in typed.schema.fields[3:]]
    # a row of lineitem makes its rows of both results where it lies, so the window's shuffle is the only one
    kept = F.expr(f"not ({_LOST})")
    sides = F.array_compact(F.array(F.lit(True), F.when(kept, F.lit(False)), F.when(kept & F.expr(_TWICE), F.lit(False))))
    each = typed.select("k", "l_linenumber", "first", F.array(*cell).alias("own")).withColumn("gold", F.explode(sides))
    other = [F.get("own", i) for i in range(width)]
    exchanged = F.expr(_EXCHANGED) & F.col("first")
    other[3], other[4] = F.when(exchanged, other[4]).otherwise(other[3]), F.when(exchanged, other[3]).otherwise(other[4])
    other[0] = F.when(F.expr(_CHANGED), F.lit("n:-1")).otherwise(other[0])
    turn = F.pmod(F.col("k"), F.lit(width)).cast("int")
    turned = F.concat(F.slice("other", turn + 1, F.lit(width) - turn), F.slice("other", F.lit(1), turn))
    laid = each.withColumn("other", F.when(~F.col("gold"), F.array(*other)))
    made = laid.select(F.col("k").alias("case_id"), "gold", F.lit(None).cast("long").alias("place"), F.when(F.col("gold"), F.col("own")).otherwise(turned).alias("cells"))
    return dn.denotation_equal(made, fx.table(spark, d, "part").select(F.col("p_partkey").alias("case_id")), dealt=True)


_LIVE = """p AS (SELECT l_orderkey AS case_id, l_partkey AS cell FROM lineitem WHERE l_orderkey % 5 <> 0 AND (l_orderkey % 3 <> 0 OR l_linenumber > 1)),
 g AS (SELECT l_orderkey AS case_id, l_partkey AS cell FROM lineitem WHERE l_orderkey % 7 <> 0)"""


@_registered(
    "live_compare",
    f"""WITH {_LIVE}, c AS (SELECT o_orderkey AS case_id FROM orders), pl AS (SELECT case_id, LIST_SORT(LIST(DISTINCT cell)) AS s FROM p GROUP BY 1), gl AS (SELECT case_id, LIST_SORT(LIST(DISTINCT cell)) AS s FROM g GROUP BY 1)
 SELECT c.case_id, pl.s IS NOT DISTINCT FROM gl.s AS matches FROM c LEFT JOIN pl ON c.case_id = pl.case_id LEFT JOIN gl ON c.case_id = gl.case_id""",
)
def live_compare(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.table(spark, d, "lineitem")
    cell = [F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("cell")]
    predicted = rows.where("l_orderkey % 5 <> 0 and (l_orderkey % 3 <> 0 or l_linenumber > 1)").select(*cell)
    return ex.live_verdicts(fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id")), predicted, rows.where("l_orderkey % 7 <> 0").select(*cell), "case_id")


@_registered(
    "crud_sample_class",
    f"""WITH {fx.CASES}, f AS (SELECT *, source_index % 11 <> 0 AS has_gold, source_index % 13 <> 0 AS has_sql, operation <> 'SELECT' AS managing, source_index % 3 <> 0 AS ran FROM cases),
 e AS (SELECT *, CASE WHEN gold_allowed AND NOT has_gold THEN 'missing_gold_sql' WHEN NOT refusal AND NOT has_sql THEN 'empty_sql' END AS error, CASE WHEN managing THEN ran ELSE ran AND COALESCE(execution_correct, FALSE) END AS good FROM f)
 SELECT source_index, CASE WHEN error IS NULL AND refusal THEN CASE WHEN gold_allowed THEN 'incorrect_refusal' ELSE 'correct_refusal' END
 ELSE CASE WHEN gold_allowed THEN '' ELSE 'violation_' END || CASE WHEN error IS NULL AND good THEN 'correct' ELSE 'wrong' END END AS classification, error FROM e""",
)
def crud_sample_class(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("source_index")
    found = ex.sample_class(F.col("gold_allowed"), k % 11 != 0, F.col("refusal"), k % 13 != 0, k % 3 != 0, F.col("execution_correct"), F.col("operation") != "SELECT")
    return fx.cases(spark, d).select(k, found.alias("r")).select("source_index", "r.*")


#: Beginnings, middles and ends of statements, and whether each leaves a statement a query that only reads.
_HEADS = [
    ("SELECT {a} FROM t", True), ("  select t.* from t", True), ("WITH r AS (SELECT {a} FROM t) SELECT * FROM r", True), ("(SELECT {a} FROM t)", True), ("SELECT REPLACE(name, 'delete', 'x') AS c{a} FROM t", True), ("VALUES ({a})", True),
    ("INSERT INTO t SELECT {a} FROM t", False), ("update t set a = {a}", False), ("WITH r AS (SELECT {a}) DELETE FROM t", False), ("SELECT {a} INTO u FROM t", False), ("SELECT java_method('java.lang.System', 'exit', '{a}') FROM t", False),
    ("SELECT UPPER(reflect('a.B', 'c', {a})) FROM t", False), ("CREATE TABLE u{a} AS SELECT 1", False), ("SELECT * FROM parquet.`/data/{a}`", False), ("EXPLAIN SELECT {a}", False),
]
_TAILS = [("", True), (";", True), (" -- drop table t", True), (" UNION ALL SELECT LOWER(b) FROM t", True), (" ; DROP TABLE t", False), (" UNION SELECT try_reflect('a.B', 'c') FROM t", False), (" FOR UPDATE", False)]


def _guarded_sql() -> str:
    case = lambda of, k: f"CASE {k} " + " ".join(f"WHEN {i} THEN {str(ok).upper()}" for i, (_, ok) in enumerate(of)) + " END"
    return f"SELECT o_orderkey AS stmt_id, {case(_HEADS, f'o_orderkey % {len(_HEADS)}')} AND {case(_TAILS, f'(o_orderkey // {len(_HEADS)}) % {len(_TAILS)}')} AS read_only FROM orders"


@_registered("read_only_guard", _guarded_sql())
def read_only_guard(spark: SparkSession, d: str) -> DataFrame:
    """A statement for each order: one of the beginnings with the customer's number in it, and one of the ends."""
    k = F.col("o_orderkey")
    pick = lambda of, i: F.element_at(F.array(*[F.lit(text) for text, _ in of]), i.cast("int") + 1)
    head = F.replace(pick(_HEADS, k % len(_HEADS)), F.lit("{a}"), F.col("o_custkey").cast("string"))
    sql = F.concat(head, pick(_TAILS, F.expr(f"o_orderkey div {len(_HEADS)}") % len(_TAILS)))
    return fx.table(spark, d, "orders").select(k.alias("stmt_id"), ex.is_read_only(sql).alias("read_only"))


_registered("value_slots", rf"WITH {fx.STATEMENTS} SELECT stmt_id, ARRAY_TO_STRING(regexp_extract_all(sql, '(^|[^\w.])(\d+)', 2), ',') AS literals FROM statements")(
    lambda spark, d: fx.statements(spark, d).select("stmt_id", F.array_join(scanning.literal_list("sql"), ",").alias("literals"))
)
_registered("unordered_cells", "SELECT ARRAY_TO_STRING(LIST_SORT([CONCAT(n_nationkey, ':bigint'), CONCAT(n_name, ':string'), CONCAT(n_regionkey, ':bigint')]), '|') AS cells FROM nation")(
    lambda spark, d: ex.unordered_cells(fx.table(spark, d, "nation").select(F.col("n_nationkey").cast("long"), "n_name", F.col("n_regionkey").cast("long"))).select(F.array_join("cells", "|").alias("cells"))
)


@_registered(
    "saved_predictions",
    """SELECT o_orderkey AS source_index, CASE WHEN o_orderkey % 3 = 2 THEN 'p' ELSE 'c' END AS pred_sql, 'r' AS prediction,
 CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 4 = 0 WHEN o_orderkey % 5 < 3 THEN o_orderkey % 5 = 0 ELSE TRUE END AS is_allowed, COALESCE(o_comment_or, '') AS input
 FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS o_comment_or FROM orders) AS t""",
)
def saved_predictions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    given = {
        "pred_sql": F.when(k % 3 == 0, "").when(k % 3 == 2, "p"), "cleaned_sql": F.lit("c"), "raw_response": F.lit("r"),
        "is_allowed": F.when(k % 2 == 0, k % 4 == 0), "expected_action": F.when(k % 5 == 0, "Allow").when(k % 5 < 3, "deny"), "question": F.when(k % 7 != 0, F.col("o_orderpriority")),
    }
    rows = fx.table(spark, d, "orders").select(k.alias("source_index"), *[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in records.SAVED.fields])
    return records.harmonised(rows).select("source_index", "pred_sql", "prediction", "is_allowed", "input")


def _predicted(cases: DataFrame) -> DataFrame:
    return cases.select("source_index", F.concat(F.lit("SELECT "), F.col("question")).alias("prediction"))


@_registered("resumed_predictions", "SELECT o_orderkey AS source_index, 'SELECT ' || o_orderpriority AS prediction FROM orders")
def resumed_predictions(spark: SparkSession, d: str) -> DataFrame:
    """A third of the cases is committed by one run; a stream over all of them adds the rest."""
    as_case = [F.col("o_orderkey").alias("source_index"), F.col("o_orderpriority").alias("question")]
    path = f"{steps.shared_folder(spark)}/{uuid.uuid4().hex}"
    log = resume.PredictionLog(spark, path, "source_index long, prediction string")
    rows = fx.table(spark, d, "orders")
    log.commit(rows.where("o_orderkey % 3 = 0").select(*as_case), _predicted, "first", 0)
    every = spark.readStream.schema(rows.schema).parquet(f"{d}/orders.parquet*").select(*as_case)
    log.stream(every, _predicted, "second", f"{path}-checkpoint").awaitTermination()
    return log.committed()


_registered(
    "case_batches",
    "WITH b AS (SELECT o_orderkey AS source_index, CAST(FLOOR((ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1) / 1000) AS BIGINT) AS batch FROM orders) SELECT batch, COUNT(*) AS n, MIN(source_index) AS first, MAX(source_index) AS last FROM b GROUP BY 1",
)(
    lambda spark, d: resume.batches_of(fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("source_index")), 1000)
    .groupBy("batch").agg(F.count("*").cast("long").alias("n"), F.min("source_index").alias("first"), F.max("source_index").alias("last"))
)


def _written_records(spark: SparkSession, d: str) -> DataFrame:
    """A JSON record for each order, in one of three layouts by o_orderkey % 3, some fields missing, null or under their other name."""
    k, gold = F.col("o_orderkey"), F.concat(F.lit("select "), F.col("o_orderkey").cast("string"))
    level = F.struct(F.col("o_orderpriority").alias("input"), F.when(k % 5 != 0, F.col("o_orderstatus")).alias("db_id"), F.lit("other").alias("database"), F.struct(F.when(k % 4 == 0, "denied").when(k % 4 == 1, "allowed").alias("permission"), gold.alias("gold_sql")).alias("metadata"), F.struct(F.array(F.lit("c")).alias("t")).alias("policy"))
    crud = F.struct(k.alias("id"), F.col("o_orderpriority").alias("input"), F.col("o_orderstatus").alias("db_id"), F.when(k % 4 != 0, k % 4 == 1).alias("allowed"), F.when(k % 7 != 0, F.upper(gold)).alias("gold_sql"), F.lit("drop x").alias("gold_output"), F.lit("c'q").alias("category"))
    return fx.table(spark, d, "orders").select(k.alias("source_index"), F.when(k % 3 == 2, F.to_json(crud)).otherwise(F.to_json(level)).alias("record"))


@_registered(
    "load_items",
    """SELECT o_orderkey AS source_index, CASE o_orderkey % 3 WHEN 0 THEN 'spider_' || o_orderkey WHEN 1 THEN 'bird_' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS id, o_orderpriority AS input,
 CASE WHEN o_orderkey % 3 = 2 OR o_orderkey % 5 <> 0 THEN o_orderstatus ELSE 'other' END AS database, CASE WHEN o_orderkey % 3 <> 2 THEN 'select ' || o_orderkey WHEN o_orderkey % 7 = 0 THEN 'drop x' ELSE 'SELECT ' || o_orderkey END AS gold_sql,
 CASE WHEN o_orderkey % 3 = 2 AND o_orderkey % 7 = 0 THEN 'DROP' ELSE 'SELECT' END AS operation, CASE WHEN o_orderkey % 3 = 2 THEN o_orderkey % 4 IN (0, 1) ELSE o_orderkey % 4 <> 0 END AS is_allowed,
 CASE WHEN o_orderkey % 3 = 2 THEN '{}' ELSE '{"t":["c"]}' END AS policy, CASE WHEN o_orderkey % 3 = 2 THEN 'c''q' END AS category FROM orders""",
)
def load_items(spark: SparkSession, d: str) -> DataFrame:
    """Three layouts from one reader."""
    texts, out = _written_records(spark, d), None
    for i, name in enumerate(items.LAYOUTS):
        one = items.items(texts.where(F.col("source_index") % 3 == i), items.layout(name))
        out = one if out is None else out.unionByName(one)
    return out.select("source_index", "id", "input", "database", "gold_sql", "operation", "is_allowed", "policy", "category")


@_registered("ground_truth", "SELECT CAST(o_orderkey AS VARCHAR) AS instance_id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'SELECT ' || o_orderkey END AS gold_sql FROM orders WHERE o_orderkey % 3 = 2")
def ground_truth(spark: SparkSession, d: str) -> DataFrame:
    return items.ground_truth(_written_records(spark, d).where(F.col("source_index") % 3 == 2), sql_key="gold_sql")
