"""Views that give the base tables the shape of scored answers, grants and responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answered question per order: the label, the refusal flag, the access status and the execution result."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    k = F.col("o_orderkey")
    joined = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return joined.select(
        k.alias("source_index"), F.col("n_name").alias("db_id"), F.col("c_mktsegment").alias("role"),
        F.concat(F.lit("q"), (k % 500).cast("string")).alias("question_key"),
        (F.col("o_custkey") % 3 != 0).alias("gold_allowed"), (k % 5 == 0).alias("refusal"),
        F.when(k % 5 == 0, "NOT_APPLICABLE").when(k % 7 == 0, "BLOCK").otherwise("PASS").alias("access_status"),
        F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("execution_correct"),
        F.col("o_orderpriority").alias("difficulty"),
        F.when(k % 4 == 0, "SELECT").when(k % 4 == 1, "INSERT").when(k % 4 == 2, "UPDATE").otherwise("DELETE").alias("operation"),
    )


CASES = """cases AS (SELECT o.o_orderkey AS source_index, n.n_name AS db_id, c.c_mktsegment AS role,
 CONCAT('q', CAST(o.o_orderkey % 500 AS VARCHAR(20))) AS question_key, (o.o_custkey % 3 <> 0) AS gold_allowed, (o.o_orderkey % 5 = 0) AS refusal,
 CASE WHEN o.o_orderkey % 5 = 0 THEN 'NOT_APPLICABLE' WHEN o.o_orderkey % 7 = 0 THEN 'BLOCK' ELSE 'PASS' END AS access_status,
 CASE o.o_orderstatus WHEN 'F' THEN TRUE WHEN 'O' THEN FALSE ELSE NULL END AS execution_correct, o.o_orderpriority AS difficulty,
 CASE o.o_orderkey % 4 WHEN 0 THEN 'SELECT' WHEN 1 THEN 'INSERT' WHEN 2 THEN 'UPDATE' ELSE 'DELETE' END AS operation
 FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey)"""


def grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role policies: a role of a database may read a column of a table."""
    li, s, p = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "part"))
    joined = li.where("l_linenumber <= 1").join(s, li["l_suppkey"] == s["s_suppkey"]).join(p, li["l_partkey"] == p["p_partkey"])
    return joined.select(F.col("s_nationkey").alias("db_id"), F.col("s_suppkey").alias("role_ord"), F.col("s_name").alias("role"), F.col("p_brand").alias("table_name"), F.col("p_type").alias("column_name")).distinct()


GRANTS = """grants AS (SELECT DISTINCT s.s_nationkey AS db_id, s.s_suppkey AS role_ord, s.s_name AS role, p.p_brand AS table_name, p.p_type AS column_name
 FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN part p ON l.l_partkey = p.p_partkey WHERE l.l_linenumber <= 1)"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of all tables."""
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("table_name"), F.col("p_type").alias("column_name")).distinct()


CATALOG = "catalog AS (SELECT DISTINCT p_brand AS table_name, p_type AS column_name FROM part)"


def required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a query needs: the columns of an order's items, asked of the database of each item's supplier."""
    li, s, p = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "part"))
    joined = li.join(s, li["l_suppkey"] == s["s_suppkey"]).join(p, li["l_partkey"] == p["p_partkey"])
    return joined.select(F.col("l_orderkey").alias("case_id"), F.col("s_suppkey").alias("role_ord"), F.col("p_brand").alias("table_name"), F.col("p_type").alias("column_name")).distinct()


REQUIRED = """required AS (SELECT DISTINCT l.l_orderkey AS case_id, s.s_suppkey AS role_ord, p.p_brand AS table_name, p.p_type AS column_name
 FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN part p ON l.l_partkey = p.p_partkey)"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with refusals, fenced SQL and empty texts among them."""
    t = table(spark, sf_dir, "conversations")
    k = F.col("turn") % 4
    response = F.when(k == 0, F.concat(F.lit("I am SORRY, I cannot answer. "), F.col("text"))).when(k == 1, F.concat(F.lit("Here is it: ```sql SELECT a FROM t; ``` "), F.col("text"))).when(k == 2, "").otherwise(F.col("text"))
    return t.select("conv_id", "turn", response.alias("response"))


RESPONSES = """responses AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN CONCAT('I am SORRY, I cannot answer. ', text)
 WHEN 1 THEN CONCAT('Here is it: ```sql SELECT a FROM t; ``` ', text) WHEN 2 THEN '' ELSE text END AS response FROM conversations)"""


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL-shaped strings, one per order, over the forms that the classifiers tell apart."""
    k = F.col("o_orderkey")
    sql = (
        F.when(k % 9 == 0, F.concat(F.lit("  SELECT DISTINCT a, ROUND(b, 2) FROM t -- all\n WHERE c > = "), k.cast("string"), F.lit(" ;")))
        .when(k % 9 == 1, F.concat(F.lit("WITH c AS (SELECT 1) INSERT INTO t SELECT * FROM c WHERE id = "), k.cast("string")))
        .when(k % 9 == 2, F.lit("update t /* note */ set a = 1; delete from u"))
        .when(k % 9 == 3, F.lit("(SELECT a FROM t) UNION (SELECT b FROM u)"))
        .when(k % 9 == 4, F.lit("SELECT a FROM t UNION SELECT b FROM u"))
        .when(k % 9 == 5, F.lit("EXPLAIN SELECT 1"))
        .when(k % 9 == 6, F.lit(""))
        .when(k % 9 == 7, F.concat(F.lit("CREATE TABLE z_"), k.cast("string"), F.lit(" AS SELECT t1.x, t2.y FROM t t1 JOIN u AS t2 ON t1.id < = t2.id")))
        .otherwise(F.lit("WITH r AS (SELECT a FROM t) SELECT YEAR(CURDATE()) FROM r"))
    )
    return table(spark, sf_dir, "orders").select(k.alias("stmt_id"), sql.alias("sql"))


STATEMENTS = """statements AS (SELECT o_orderkey AS stmt_id, CASE o_orderkey % 9
 WHEN 0 THEN CONCAT('  SELECT DISTINCT a, ROUND(b, 2) FROM t -- all', chr(10), ' WHERE c > = ', CAST(o_orderkey AS VARCHAR(20)), ' ;')
 WHEN 1 THEN CONCAT('WITH c AS (SELECT 1) INSERT INTO t SELECT * FROM c WHERE id = ', CAST(o_orderkey AS VARCHAR(20)))
 WHEN 2 THEN 'update t /* note */ set a = 1; delete from u' WHEN 3 THEN '(SELECT a FROM t) UNION (SELECT b FROM u)' WHEN 4 THEN 'SELECT a FROM t UNION SELECT b FROM u'
 WHEN 5 THEN 'EXPLAIN SELECT 1' WHEN 6 THEN '' WHEN 7 THEN CONCAT('CREATE TABLE z_', CAST(o_orderkey AS VARCHAR(20)), ' AS SELECT t1.x, t2.y FROM t t1 JOIN u AS t2 ON t1.id < = t2.id')
 ELSE 'WITH r AS (SELECT a FROM t) SELECT YEAR(CURDATE()) FROM r' END AS sql FROM orders)"""


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRUD policies from the grants: wildcards, names in other case, whole tables, tables that no schema knows, DDL, managers and admins."""
    k = F.col("role_ord")
    role = F.when(k % 13 == 0, "SystemManager").when(k % 17 == 0, F.concat("role", F.lit(" Admin"))).otherwise(F.col("role"))
    g = grants(spark, sf_dir).withColumn("role", role)
    row = lambda rows, op, t, c: rows.select("db_id", "role", F.lit(op).alias("operation"), t.alias("table_name"), c.alias("column_name"))
    t, c, none = F.col("table_name"), F.col("column_name"), F.lit(None).cast("string")
    parts = [
        row(g, "SELECT", t, F.when((k % 7 == 0) & t.endswith("3"), "*").otherwise(c)), row(g.where(F.length("column_name") % 3 == 0), "UPDATE", F.upper(t), c), row(g.where(k % 3 == 0), "INSERT", t, none),
        row(g.where((k % 4 == 1) & t.rlike("[12]$")), "DELETE", F.lower(t), none), row(g.where(k % 5 == 0), "INSERT", F.lit("Extra"), none), row(g.where(k % 11 == 0), "DDL", none, none),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that each database lists: those of every other role."""
    return grants(spark, sf_dir).where("role_ord % 2 = 1").select("db_id", "table_name", "column_name").distinct()


POLICIES = f"""{GRANTS}, g AS (SELECT *, CASE WHEN role_ord % 13 = 0 THEN 'SystemManager' WHEN role_ord % 17 = 0 THEN role || ' Admin' ELSE role END AS r FROM grants),
 policies AS (SELECT db_id, r AS role, 'SELECT' AS operation, LOWER(table_name) AS t, CASE WHEN role_ord % 7 = 0 AND table_name LIKE '%3' THEN '*' ELSE LOWER(column_name) END AS c FROM g
 UNION SELECT db_id, r, 'UPDATE', LOWER(table_name), LOWER(column_name) FROM g WHERE LENGTH(column_name) % 3 = 0 UNION SELECT db_id, r, 'INSERT', LOWER(table_name), NULL FROM g WHERE role_ord % 3 = 0
 UNION SELECT db_id, r, 'DELETE', LOWER(table_name), NULL FROM g WHERE role_ord % 4 = 1 AND (table_name LIKE '%1' OR table_name LIKE '%2') UNION SELECT db_id, r, 'INSERT', 'extra', NULL FROM g WHERE role_ord % 5 = 0
 UNION SELECT db_id, r, 'DDL', NULL, NULL FROM g WHERE role_ord % 11 = 0),
 schema_ AS (SELECT DISTINCT db_id, LOWER(table_name) AS t, LOWER(column_name) AS c FROM grants WHERE role_ord % 2 = 1),
 perms AS (SELECT db_id, role, operation, t, c FROM policies WHERE operation IN ('SELECT', 'UPDATE') AND c <> '*' UNION SELECT p.db_id, role, operation, p.t, s.c FROM policies p JOIN schema_ s ON s.db_id = p.db_id AND s.t = p.t WHERE p.c = '*' OR operation IN ('INSERT', 'DELETE')
 UNION SELECT db_id, role, operation, t, '*' FROM policies p WHERE operation IN ('INSERT', 'DELETE') AND NOT EXISTS (SELECT 1 FROM schema_ s WHERE s.db_id = p.db_id AND s.t = p.t))"""


#: Three tables whose columns have names of their own.
BUILT_SCHEMA = {f"t{a}": [f"x{a}{i}" for i in range(5)] for a in range(3)}
#: Numbers of an order from which its statement is put together: form, two tables and three columns.
_PIECES = {"f": "o_orderkey % 6", "a": "o_orderkey % 3", "b": "(o_orderkey + 1) % 3", "i": "o_custkey % 5", "j": "CAST(FLOOR(o_orderkey / 7) AS BIGINT) % 5", "m": "CAST(FLOOR(o_custkey / 3) AS BIGINT) % 5"}
#: The forms, with {ai} for column i of table a, and the resources of each as (operation, table, column).
BUILT_FORMS = [
    ("SELECT {ai} FROM {a} WHERE {aj} > {n}", [("SELECT", "a", ""), ("SELECT", "a", "i"), ("SELECT", "a", "j")]),
    ("SELECT p.{ai}, COUNT(*) FROM {a} p JOIN {b} AS q ON p.{aj} = q.{bm} GROUP BY p.{ai} -- {n}", [("SELECT", "a", ""), ("SELECT", "b", ""), ("SELECT", "a", "i"), ("SELECT", "a", "j"), ("SELECT", "b", "m")]),
    ("UPDATE {a} SET {ai} = {n} WHERE {aj} = 'x;y'", [("UPDATE", "a", "i"), ("SELECT", "a", "j")]),
    ("DELETE FROM {a} WHERE {ai} IN (SELECT {bj} FROM {b} WHERE {bm} < {n})", [("DELETE", "a", ""), ("SELECT", "a", "i"), ("SELECT", "b", ""), ("SELECT", "b", "j"), ("SELECT", "b", "m")]),
    ("INSERT INTO {a} ({ai}) SELECT {bj} FROM {b} WHERE {bm} <> {n}", [("INSERT", "a", ""), ("SELECT", "b", ""), ("SELECT", "b", "j"), ("SELECT", "b", "m")]),
    ("WITH r AS (SELECT {ai} AS v FROM {a}) SELECT v FROM r UNION SELECT {bj} FROM {b} WHERE {bm} = {n}", [("SELECT", "a", ""), ("SELECT", "a", "i"), ("SELECT", "b", ""), ("SELECT", "b", "j"), ("SELECT", "b", "m")]),
]


def built_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement for each order (stmt_id, sql), put together from its numbers, so that most are unlike; and a policy as JSON."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", *[F.expr(e).cast("string").alias(k) for k, e in _PIECES.items()])
    sql = F.element_at(F.array(*[F.lit(text) for text, _ in BUILT_FORMS]), F.col("f").cast("int") + 1)
    for t in "ab":
        for c in "ijm":
            sql = F.replace(sql, F.lit(f"{{{t}{c}}}"), F.concat(F.lit("x"), F.col(t), F.col(c)))
        sql = F.replace(sql, F.lit(f"{{{t}}}"), F.concat(F.lit("t"), F.col(t)))
    sql = F.replace(sql, F.lit("{n}"), F.col("o_custkey").cast("string"))
    few, more = (", ".join(f'"x{{}}{i}"' for i in range(n)) for n in (3, 4))
    tables = ", ".join(f'"t{a}": {{"SELECT": [{few if a else more}], "UPDATE": ["x{a}0"]}}'.replace("x{}", f"x{a}") for a in range(3))
    policy = f'{{"tables": {{{tables}}}, "INSERT": ["t1"], "DELETE": ["t0", "t2"], "DDL": false}}'
    return o.select(F.col("o_orderkey").alias("stmt_id"), sql.alias("sql"), F.lit(policy).alias("policy"))


def _built_resources() -> str:
    parts = []
    for f, (_, found) in enumerate(BUILT_FORMS):
        for op, t, c in found:
            column = f"'x' || {t} || {c}" if c else "''"
            parts.append(f"SELECT stmt_id, '{op}' AS op, 't' || {t} AS table_name, {column} AS column_name FROM pieces WHERE f = {f}")
    return " UNION ".join(parts)


BUILT = f"""pieces AS (SELECT o_orderkey AS stmt_id, {", ".join(f"{e} AS {k}" for k, e in _PIECES.items())} FROM orders), resources AS ({_built_resources()}),
 lacking AS (SELECT * FROM resources WHERE (op = 'SELECT' AND column_name <> '' AND CAST(RIGHT(column_name, 1) AS INT) >= CASE table_name WHEN 't0' THEN 4 ELSE 3 END) OR (op = 'UPDATE' AND column_name NOT LIKE '%0')
 OR (op = 'INSERT' AND table_name <> 't1') OR (op = 'DELETE' AND table_name = 't1'))"""
