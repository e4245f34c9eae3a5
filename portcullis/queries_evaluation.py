"""Registered queries of the steps around an evaluation, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from .functions import roles
from .operators import evaluation as ev
from .operators import quality, sampling, textmetrics
from .queries import _registered

_CACHE = "cache AS (SELECT o_orderkey AS source_index, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey % 4 = 0 END AS execution_correct, CASE WHEN o_orderkey % 10 = 0 THEN 'x' ELSE o_orderpriority END AS difficulty FROM orders WHERE o_orderkey % 3 = 0)"


def _cache(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = fx.table(spark, d, "orders").where(k % 3 == 0)
    return o.select(k.alias("source_index"), F.when(k % 6 != 0, k % 4 == 0).alias("execution_correct"), F.when(k % 10 == 0, "x").otherwise(F.col("o_orderpriority")).alias("difficulty"))


_registered("align_predictions", f"WITH {fx.CASES}, {_CACHE} SELECT c.source_index, CASE WHEN k.source_index IS NULL THEN c.execution_correct ELSE k.execution_correct END AS execution_correct, k.source_index IS NOT NULL AS from_cache FROM cases c LEFT JOIN cache k ON c.source_index = k.source_index")(
    lambda spark, d: ev.with_cached(fx.cases(spark, d), _cache(spark, d)).select("source_index", "execution_correct", "from_cache")
)
_registered(
    "cache_validation",
    f"""WITH {fx.CASES}, {_CACHE}, all_rows AS (SELECT * FROM cache UNION ALL SELECT * FROM cache WHERE source_index % 9 = 0 UNION ALL SELECT -source_index, TRUE, difficulty FROM cache WHERE source_index % 5 = 0),
 p AS (SELECT a.source_index, CASE WHEN COUNT(*) OVER (PARTITION BY a.source_index) > 1 THEN 'repeated' WHEN c.source_index IS NULL THEN 'no case' WHEN a.execution_correct IS NULL THEN 'no result' WHEN a.difficulty <> c.difficulty THEN 'other text' END AS problem
 FROM all_rows a LEFT JOIN cases c ON a.source_index = c.source_index) SELECT DISTINCT source_index, problem FROM p WHERE problem IS NOT NULL""",
)(
    lambda spark, d: ev.cache_problems(
        (c := _cache(spark, d)).unionByName(c.where("source_index % 9 = 0")).unionByName(c.where("source_index % 5 = 0").select((-F.col("source_index")).alias("source_index"), F.lit(True).alias("execution_correct"), "difficulty")),
        fx.cases(spark, d),
        ["difficulty"],
    )
)
_registered("trial_needed", "SELECT DISTINCT source_index FROM (SELECT o_orderkey AS source_index FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)")(
    lambda spark, d: ev.needed((o := fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("source_index"))).where("source_index % 2 = 0").unionByName(o.where("source_index % 3 = 0")))
)
_EXPOSED = "v AS (SELECT difficulty, CASE source_index % 4 WHEN 0 THEN 'valid_guess' WHEN 1 THEN 'invalid_guess' ELSE 'no_unauthorized' END AS exposure FROM cases WHERE NOT gold_allowed AND NOT refusal), both_rows AS (SELECT * FROM v UNION ALL SELECT 'all', exposure FROM v)"


def _rate(n: str) -> str:
    return f"ROUND(CAST(COUNT(*) FILTER (exposure = '{n}') AS DOUBLE) / COUNT(*), 6) AS {n}_rate"


_registered(
    "exposure_metrics",
    f"WITH {fx.CASES}, {_EXPOSED} SELECT difficulty, " + ", ".join(f"COUNT(*) FILTER (exposure = '{n}') AS {n}, {_rate(n)}" for n in ("valid_guess", "invalid_guess", "no_unauthorized")) + ", COUNT(*) AS total_violations FROM both_rows GROUP BY 1",
)(
    lambda spark, d: ev.exposure_metrics(
        fx.cases(spark, d).where("not gold_allowed and not refusal").select("difficulty", F.when(F.col("source_index") % 4 == 0, "valid_guess").when(F.col("source_index") % 4 == 1, "invalid_guess").otherwise("no_unauthorized").alias("exposure")), "difficulty"
    )
)
_registered("non_sm_deny", f"WITH {fx.CASES}, s AS (SELECT db_id, COUNT(*) AS total, COUNT(*) FILTER (NOT gold_allowed) AS denied FROM cases WHERE role <> 'BUILDING' GROUP BY 1) SELECT db_id, total, denied, ROUND(100.0 * denied / total, 6) AS deny_rate, CASE WHEN 100.0 * denied / total BETWEEN 5 AND 85 THEN 'OK' ELSE 'WARN' END AS status FROM s")(
    lambda spark, d: ev.manager_free_deny(fx.cases(spark, d), manager="BUILDING")
)
_ROLES = "o AS (SELECT DISTINCT db_id, role FROM grants WHERE role_ord % 2 = 0), n AS (SELECT DISTINCT db_id, role FROM grants WHERE role_ord % 3 = 0)"
_registered(
    "role_selection",
    f"WITH {fx.GRANTS}, {_ROLES} SELECT db_id, role, 'OLD' AS version FROM o WHERE db_id % 3 = 0 OR (db_id % 3 = 1 AND RIGHT(role, 1) = '4') UNION ALL SELECT db_id, role, 'NEW' FROM n WHERE db_id % 2 = 0",
)(
    lambda spark, d: (
        (g := fx.grants(spark, d).select("db_id", "role", "role_ord").distinct()),
        (o := g.where("role_ord % 2 = 0").select("db_id", "role")),
        (n := g.where("role_ord % 3 = 0").select("db_id", "role")),
        (chosen := g.where("db_id % 3 = 0").select("db_id", F.lit("OLD").alias("version"), F.lit("*").alias("role")).union(g.where("db_id % 3 = 1 and right(role, 1) = '4'").select("db_id", F.lit("OLD"), "role")).union(g.where("db_id % 2 = 0").select("db_id", F.lit("NEW"), F.lit("*")))),
        ev.selected_roles(o, n, chosen),
    )[-1]
)
_registered(
    "role_set_compare",
    f"""WITH {fx.GRANTS}, {fx.CATALOG}, held AS (SELECT DISTINCT db_id, CASE role_ord % 2 WHEN 0 THEN 'OLD' ELSE 'NEW' END AS version, role_ord, table_name, column_name FROM grants), sz AS (SELECT db_id, version, role_ord, COUNT(*) AS held FROM held GROUP BY 1, 2, 3),
 shares AS (SELECT db_id, version, CAST(held AS DOUBLE) / (SELECT COUNT(*) FROM catalog) AS s FROM sz), own AS (SELECT db_id, version, AVG(s) AS coverage, STDDEV_POP(s) AS coverage_std FROM shares GROUP BY 1, 2),
 pairs AS (SELECT a.db_id, a.version, a.role_ord AS x, b.role_ord AS y, COUNT(*) AS c FROM held a JOIN held b ON a.db_id = b.db_id AND a.version = b.version AND a.table_name = b.table_name AND a.column_name = b.column_name AND a.role_ord < b.role_ord GROUP BY 1, 2, 3, 4),
 most AS (SELECT p.db_id, p.version, MAX(CAST(c AS DOUBLE) / (x.held + y.held - c)) AS m FROM pairs p JOIN sz x ON x.db_id = p.db_id AND x.role_ord = p.x JOIN sz y ON y.db_id = p.db_id AND y.role_ord = p.y GROUP BY 1, 2)
 SELECT o.db_id, o.version, ROUND(coverage, 6) AS coverage, ROUND(coverage_std, 6) AS coverage_std, ROUND(COALESCE(m, 0), 6) AS max_overlap, CASE WHEN coverage > 0.9 THEN 'WARN' ELSE 'OK' END AS coverage_status,
 CASE WHEN coverage_std < 0.065 THEN 'WARN' ELSE 'OK' END AS std_status, CASE WHEN COALESCE(m, 0) > 0.9 THEN 'WARN' ELSE 'OK' END AS overlap_status FROM own o LEFT JOIN most m ON o.db_id = m.db_id AND o.version = m.version""",
)(lambda spark, d: _compared(spark, d))


def _compared(spark: SparkSession, d: str) -> DataFrame:
    version = F.when(F.col("role_ord") % 2 == 0, "OLD").otherwise("NEW")
    g = fx.grants(spark, d).withColumn("version", version).withColumn("db", F.concat_ws("|", "db_id", "version"))
    size = fx.catalog(spark, d).agg(F.count("*").alias("columns"))
    sizes = g.groupBy("db_id", "version", F.col("role_ord").alias("role")).agg(F.count("*").alias("held")).crossJoin(F.broadcast(size))  # one row beside
    part = F.split("db", r"\|")
    pairs = quality.greatest_overlap(g.select("db", "role_ord", "table_name", "column_name"), by="db").select(part[0].cast("int").alias("db_id"), part[1].alias("version"), F.col("max").alias("overlap"))
    return ev.role_set_compare(sizes, pairs.withColumn("db_id", F.col("db_id").cast(g.schema["db_id"].dataType)))


_NEED = "need AS (SELECT o_orderkey AS case_id, CASE o_orderkey % 5 WHEN 0 THEN 'read' WHEN 1 THEN 'write' WHEN 2 THEN 'insert' WHEN 3 THEN 'delete' ELSE 'ddl' END AS kind, o_orderpriority AS table_name, o_orderstatus AS column_name FROM orders)"


def _need(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("read", "write", "insert", "delete", "ddl"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), kind.alias("kind"), F.col("o_orderpriority").alias("table_name"), F.col("o_orderstatus").alias("column_name"))


_ALLOWED = (("read", "1-URGENT", "*"), ("read", "2-HIGH", "F"), ("write", "2-HIGH", "O"), ("insert", "3-MEDIUM", None), ("delete", "1-URGENT", None))
_registered(
    "allow_set_check",
    f"""WITH {_NEED} SELECT case_id, kind, table_name, column_name FROM need WHERE NOT ((kind = 'read' AND (table_name = '1-URGENT' OR (table_name = '2-HIGH' AND column_name = 'F'))) OR (kind = 'write' AND table_name = '2-HIGH' AND column_name = 'O')
 OR (kind = 'insert' AND table_name = '3-MEDIUM') OR (kind = 'delete' AND table_name = '1-URGENT'))""",
)(lambda spark, d: ev.allow_set_missing(_need(spark, d), spark.createDataFrame(_ALLOWED, "kind string, table_name string, column_name string")))
_registered("schema_suffix", "WITH r AS (SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN CONCAT(r_name, '_M') WHEN 1 THEN r_name ELSE 'none' END AS db_id, r_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT n_nationkey, db_id, CASE WHEN db_id = 'none' THEN NULL ELSE CAST(r_regionkey AS BIGINT) END AS columns FROM r")(
    lambda spark, d: (
        (r := fx.table(spark, d, "region")),
        (n := fx.table(spark, d, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey"))),
        (k := F.col("n_nationkey") % 3),
        ev.schema_of(n.select("n_nationkey", F.when(k == 0, F.concat("r_name", F.lit("_M"))).when(k == 1, F.col("r_name")).otherwise("none").alias("db_id")), r.select(F.col("r_name").alias("db_id"), F.col("r_regionkey").cast("long").alias("columns"))),
    )[-1]
)
_registered("entry_fields", f"WITH {fx.CASES} SELECT source_index, CASE WHEN source_index % 3 = 0 THEN CASE WHEN gold_allowed THEN 'allowed' ELSE 'denied' END WHEN source_index % 3 = 1 THEN 'allowed' ELSE 'denied' END AS permission FROM cases")(
    lambda spark, d: fx.cases(spark, d).select("source_index", ev.permission_of(F.when(F.col("source_index") % 3 == 0, F.col("gold_allowed")), F.when(F.col("source_index") % 3 == 1, "allowed")).alias("permission"))
)
_registered("named_filters", f"WITH {fx.CASES} SELECT role, COUNT(*) AS n FROM cases WHERE role <> 'BUILDING' AND LOWER(CASE WHEN role = 'MACHINERY' THEN 'DbAdmin' ELSE role END) NOT LIKE '%admin%' GROUP BY 1")(
    lambda spark, d: ev.no_admins(ev.other_than(fx.cases(spark, d), manager="BUILDING").withColumn("role", F.when(F.col("role") == "MACHINERY", "DbAdmin").otherwise(F.col("role")))).groupBy("role").agg(F.count("*").cast("long").alias("n"))
)
_registered("panel_chunks", "SELECT n_name, CAST((ROW_NUMBER() OVER (ORDER BY n_name) - 1) // 4 AS INTEGER) AS panel FROM nation")(lambda spark, d: ev.panels(fx.table(spark, d, "nation"), "n_name", 4))
_registered("rank_map", f"WITH {fx.CASES} SELECT source_index, CASE operation WHEN 'SELECT' THEN 0 WHEN 'UPDATE' THEN 1 WHEN 'INSERT' THEN 2 ELSE 999 END AS r FROM cases")(lambda spark, d: fx.cases(spark, d).select("source_index", ev.ranked("operation", ["SELECT", "UPDATE", "INSERT"]).alias("r")))
_registered("first_ordered", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")(lambda spark, d: fx.table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(100))
_registered("lowest_similarity", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 5")(lambda spark, d: fx.table(spark, d, "customer").select("c_custkey", "c_acctbal").orderBy("c_acctbal", "c_custkey").limit(5))
_registered("question_prefix", "SELECT conv_id, turn, LEFT(COALESCE(text, ''), 200) AS k FROM conversations")(lambda spark, d: fx.table(spark, d, "conversations").select("conv_id", "turn", roles.question_prefix(F.concat("text", F.lit("\n\nSchema: t(a)"))).alias("k")))
_registered("usage_statistics", "SELECT event_type, COUNT(*) AS calls, COUNT(*) FILTER (event_id % 3 = 0) AS hits, CAST(SUM(event_id % 100) AS BIGINT) AS tokens, CAST(SUM(event_id % 7) AS BIGINT) AS seconds, ROUND(CAST(COUNT(*) FILTER (event_id % 3 = 0) AS DOUBLE) / COUNT(*), 6) AS hit_rate, ROUND(CAST(SUM(event_id % 100) AS DOUBLE) / SUM(event_id % 7), 6) AS tokens_per_second FROM events GROUP BY 1")(
    lambda spark, d: ev.usage_statistics(fx.table(spark, d, "events").select("event_type", (F.col("event_id") % 3 == 0).alias("cached"), (F.col("event_id") % 100).alias("tokens"), (F.col("event_id") % 7).alias("seconds")), "event_type")
)
_registered("db_statistics", f"WITH {fx.GRANTS}, f AS (SELECT n_nationkey AS db_id, CASE n_nationkey % 2 WHEN 0 THEN 'sqlite' ELSE 'schema' END AS kind FROM nation), t AS (SELECT db_id, COUNT(DISTINCT table_name) AS n FROM grants GROUP BY 1) SELECT f.db_id, kind = 'sqlite' AS has_sqlite, kind = 'schema' AS has_schema, COALESCE(n, 0) AS table_count FROM f LEFT JOIN t ON f.db_id = t.db_id")(
    lambda spark, d: ev.database_statistics(fx.table(spark, d, "nation").select(F.col("n_nationkey").alias("db_id"), F.when(F.col("n_nationkey") % 2 == 0, "sqlite").otherwise("schema").alias("kind")), fx.grants(spark, d))
)
_registered("sampled_validation")(lambda spark, d: ev.sampled_listing(fx.cases(spark, d), "operation", "source_index").select("operation", "place", "source_index"))
_registered("table_roles", f"WITH {fx.GRANTS}, t AS (SELECT DISTINCT db_id, role, table_name FROM grants) SELECT db_id, role, STRING_AGG(table_name, ',' ORDER BY table_name) AS tables FROM t GROUP BY 1, 2")(lambda spark, d: ev.table_roles(fx.grants(spark, d), ["db_id", "role"]).withColumn("tables", F.concat_ws(",", "tables")))
_registered("meaning_preview", f"WITH {fx.GRANTS}, m AS (SELECT DISTINCT CAST(db_id AS VARCHAR(20)) AS db_id, table_name, column_name FROM grants), r AS (SELECT *, DENSE_RANK() OVER (PARTITION BY db_id ORDER BY table_name) AS t, ROW_NUMBER() OVER (PARTITION BY db_id, table_name ORDER BY column_name) AS c FROM m) SELECT db_id, table_name, column_name FROM r WHERE t <= 6 AND c <= 4")(
    lambda spark, d: ev.meaning_preview(fx.grants(spark, d).select(F.concat_ws("|", F.col("db_id").cast("string"), "table_name", "column_name").alias("key")).distinct())
)
# Roles as a model writes them, with the answer's form by the order's key.
_TEXT = "ROLE: Reader {k}\nDESCRIPTION: reads things\nCOLUMNS:\n  orders: id, total\n  parts: *\nROLE: Empty\nCOLUMNS:\n"
_JSON = '```json\n[{"role": "Writer", "description": "writes", "columns": {"orders": ["id"]}}]\n```'
_registered("parse_column_roles", "SELECT o_orderkey, 'Reader' AS role, 'reads things' AS description, t.table_name, t.column_name FROM orders, (VALUES ('orders', 'id'), ('orders', 'total'), ('parts', '*')) t(table_name, column_name) WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'Writer', 'writes', 'orders', 'id' FROM orders WHERE o_orderkey % 3 = 1")(
    lambda spark, d: roles.exploded(fx.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, _TEXT.replace(" {k}", "")).when(F.col("o_orderkey") % 3 == 1, _JSON).otherwise("[ no json").alias("text")), "o_orderkey", "text")
)


def _text_pairs(spark: SparkSession, d: str) -> DataFrame:
    """For each document a text to judge against it: of even ones the text without every seventh word, of odd ones the one before."""
    docs = fx.table(spark, d, "documents").select("doc_id", "text")
    words = F.filter(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), lambda w, i: i % 7 != 3)
    before = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("other"))
    return docs.join(before, "doc_id", "left").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.array_join(words, " ")).otherwise(F.col("other")).alias("prediction"), F.col("text").alias("reference"))


_registered("text_generation_metrics")(lambda spark, d: textmetrics.text_metrics(_text_pairs(spark, d), "doc_id"))
_ROUGE = " ".join(
    f""", a{n} AS (SELECT doc_id, g, COUNT(*) AS n FROM (SELECT doc_id, UNNEST(LIST_TRANSFORM(RANGE(1, LEN(p) - {n - 2}), lambda i: ARRAY_TO_STRING(p[i : i + {n - 1}], ' '))) AS g FROM w) AS t GROUP BY 1, 2),
 b{n} AS (SELECT doc_id, g, COUNT(*) AS n FROM (SELECT doc_id, UNNEST(LIST_TRANSFORM(RANGE(1, LEN(r) - {n - 2}), lambda i: ARRAY_TO_STRING(r[i : i + {n - 1}], ' '))) AS g FROM w) AS t GROUP BY 1, 2),
 s{n} AS (SELECT a.doc_id, SUM(LEAST(a.n, b.n)) AS s FROM a{n} a JOIN b{n} b ON a.doc_id = b.doc_id AND a.g = b.g GROUP BY 1),
 f{n} AS (SELECT w.doc_id, CASE WHEN LEN(p) < {n} OR LEN(r) < {n} THEN 0.0 ELSE COALESCE(s, 0) / CAST(LEN(p) - {n - 1} AS DOUBLE) END AS p, CASE WHEN LEN(p) < {n} OR LEN(r) < {n} THEN 0.0 ELSE COALESCE(s, 0) / CAST(LEN(r) - {n - 1} AS DOUBLE) END AS r
 FROM w LEFT JOIN s{n} s ON s.doc_id = w.doc_id)"""
    for n in (1, 2)
)
_registered(
    "rouge_n",
    rf"""WITH d AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS r FROM documents),
 w AS (SELECT d.doc_id, d.r, CASE WHEN d.doc_id % 2 = 0 THEN LIST_FILTER(d.r, lambda x, i: (i - 1) % 7 <> 3) ELSE COALESCE(e.r, []) END AS p FROM d LEFT JOIN d e ON e.doc_id + 1 = d.doc_id) {_ROUGE}
 SELECT f1.doc_id, ROUND(100 * 2 * (f1.p * f1.r) / (f1.p + f1.r + 1e-8), 4) AS rouge_1, ROUND(100 * 2 * (f2.p * f2.r) / (f2.p + f2.r + 1e-8), 4) AS rouge_2 FROM f1 JOIN f2 ON f1.doc_id = f2.doc_id""",
)(lambda spark, d: textmetrics.text_metrics(_text_pairs(spark, d), "doc_id").select("doc_id", "rouge_1", "rouge_2"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    """A JSON record for each order, its keys in no order, and what was predicted for it."""
    gold = F.concat(F.lit("SELECT "), F.col("o_orderkey").cast("string"))
    meta = F.struct((F.col("o_orderkey") % 2 == 0).alias("permission"), F.when(F.col("o_orderkey") % 3 != 0, gold).alias("gold_sql"))
    record = F.struct(F.col("o_orderpriority").alias("input"), meta.alias("metadata"), F.array(F.lit(2), F.lit(1)).alias("deep"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("")).alias("gold_sql"), F.lit("é \"x\"").alias("output"), F.col("o_orderkey").alias("db_id"))
    return fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("source_index"), F.to_json(record).alias("record"), F.col("o_orderstatus").alias("prediction"))


_RECORDS = """r AS (SELECT o_orderkey AS k, '{"db_id":' || o_orderkey || ',"deep":[2,1]' || CASE WHEN o_orderkey % 3 = 0 THEN ',"gold_sql":""' ELSE '' END || ',"input":"' || o_orderpriority || '","metadata":{' ||
 CASE WHEN o_orderkey % 3 <> 0 THEN '"gold_sql":"SELECT ' || o_orderkey || '",' ELSE '' END || '"permission":' || CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END || '},"output":"é \\"x\\""}' AS j,
 CASE WHEN o_orderkey % 3 <> 0 THEN 'SELECT ' || o_orderkey ELSE 'é "x"' END AS gold, o_orderstatus AS p FROM orders)"""
_registered("record_digests", f"WITH {_RECORDS} SELECT k AS source_index, sha256(j) AS row_sha256, sha256(p) AS prediction_sha256, sha256(gold) AS gold_sql_sha256 FROM r")(lambda spark, d: ev.bindings(_records(spark, d), _records(spark, d)))


@_registered(
    "cache_binding",
    f"""WITH {_RECORDS}, c AS (SELECT k, sha256(j) AS a, CASE WHEN k % 5 = 0 THEN sha256(p || 'x') ELSE sha256(p) END AS b, CASE WHEN k % 7 = 0 THEN NULL ELSE sha256(gold) END AS g FROM r
 UNION ALL SELECT k, sha256(j), sha256(p), sha256(gold) FROM r WHERE k % 11 = 0 UNION ALL SELECT -k, 'x', 'x', 'x' FROM r WHERE k % 13 = 0),
 m AS (SELECT c.*, COUNT(*) OVER (PARTITION BY c.k) AS n, r.k AS rk, sha256(r.p) AS rp, sha256(r.gold) AS rg FROM c LEFT JOIN r ON c.k = r.k)
 SELECT DISTINCT k AS source_index, CASE WHEN n > 1 THEN 'repeated' WHEN rk IS NULL THEN 'out of range' WHEN b <> rp THEN 'prediction_sha256' ELSE 'gold_sql_sha256' END AS problem FROM m WHERE n > 1 OR rk IS NULL OR b <> rp OR g IS NULL""",
)
def cache_binding(spark: SparkSession, d: str) -> DataFrame:
    """Cached results of all orders, some bound to another prediction, without a digest, repeated, or of no case."""
    k, rows = F.col("source_index"), _records(spark, d)
    right = ev.bindings(rows, rows)
    wrong = ev.bindings(rows, rows.withColumn("prediction", F.when(k % 5 == 0, F.concat("prediction", F.lit("x"))).otherwise(F.col("prediction")))).withColumn("gold_sql_sha256", F.when(k % 7 != 0, F.col("gold_sql_sha256")))
    none = right.where(k % 13 == 0).select((-k).alias("source_index"), *[F.lit("x").alias(c) for c in ev.BOUND])
    return ev.binding_problems(wrong.unionByName(right.where(k % 11 == 0)).unionByName(none), right)


#: How a role is written and what is read of it, by a number: the heading's form, what stands between the lines, and the end.
_ROLE_FORMS = [
    ("ROLE: {n}\nDESCRIPTION: does {d}\nTABLES: {t}\n\n", "{n}", True), ("**Role:** *{n}* - all\nDescription: does {d}\n\nTables: {t}, extra\n\n", "{n}", True),
    ("1. ROLE\uff1a {n} \u2013 x\n  TABLES: `{t}`\n  DESCRIPTION: does   {d}\n", "{n}", True), ("ROLE: {n}\nof the firm\nDESCRIPTION: old\nDESCRIPTION: does {d}\nTABLES: [{t}]\n\n", "{n} of the firm", True),
    ("ROLE: {n}\nDESCRIPTION: does {d}\n\n", None, False), ("ROLE: - {n}\nDESCRIPTION: does {d}\nTABLES: {t}\n\n", None, False), ("no role here\n\n", None, False),
]


def _roles_sql() -> str:
    n = len(_ROLE_FORMS)
    name = "CASE {f} " + " ".join(f"WHEN {i} THEN {'NULL' if kept is None else chr(39) + kept.replace('{n}', chr(39) + ' || name || ' + chr(39)) + chr(39)}" for i, (_, kept, _) in enumerate(_ROLE_FORMS)) + " END"
    extra = "CASE WHEN {f} = 1 THEN ', extra' ELSE '' END"
    # a role that the next heading closes is not marked: the third form has no blank line behind it, and is followed by one in the first place
    unknown = "CASE WHEN {f} = 2 AND {closed} THEN '' ELSE CASE WHEN {f} = 1 AND t <> 't1' AND t <> 't2' THEN ' NEED HUMAN VERIFICATION (Invalid tables: extra, ' || t || ')' WHEN {f} = 1 THEN ' NEED HUMAN VERIFICATION (Invalid tables: extra)' WHEN t <> 't1' AND t <> 't2' THEN ' NEED HUMAN VERIFICATION (Invalid tables: ' || t || ')' ELSE '' END END"
    one = lambda f, ordinal, closed: f"SELECT k, {ordinal} AS ordinal, {name.format(f=f)} AS role, 'does ' || p AS description, t || {extra.format(f=f)} || {unknown.format(f=f, closed=closed)} AS tables FROM o"
    closed = f"b IN ({', '.join(str(i) for i, (text, _, _) in enumerate(_ROLE_FORMS) if 'role' in text.lower() and i < n - 1)})"
    base = f"o AS (SELECT o_orderkey AS k, o_orderkey % {n} AS a, (o_orderkey // {n}) % {n} AS b, 'r' || (o_custkey % 9) AS name, o_orderpriority AS p, 't' || (o_custkey % 4) AS t FROM orders)"
    return f"WITH {base}, both_roles AS ({one('a', 0, closed)} UNION ALL {one('b', 1, 'FALSE')}) SELECT k AS answer_id, role, description, tables FROM both_roles WHERE role IS NOT NULL"


@_registered("parse_table_roles", _roles_sql())
def parse_table_roles(spark: SparkSession, d: str) -> DataFrame:
    """Two written roles an order, each in one of seven forms, read against two known tables."""
    n = len(_ROLE_FORMS)
    o = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("answer_id"), "o_custkey", "o_orderpriority")
    written = F.array(*[F.lit(text) for text, _, _ in _ROLE_FORMS])
    text = F.concat(F.element_at(written, (F.col("answer_id") % n).cast("int") + 1), F.element_at(written, (F.expr(f"answer_id div {n}") % n).cast("int") + 1))
    for mark, value in (("{n}", F.concat(F.lit("r"), (F.col("o_custkey") % 9).cast("string"))), ("{d}", F.col("o_orderpriority")), ("{t}", F.concat(F.lit("t"), (F.col("o_custkey") % 4).cast("string")))):
        text = F.replace(text, F.lit(mark), value)
    read = o.select("answer_id", F.explode(roles.table_roles(text, F.array(F.lit("t1"), F.lit("t2")))).alias("r"))
    return read.select("answer_id", "r.role", "r.description", "r.tables")


_registered(
    "query_sample",
    f"""WITH {fx.CASES}, n AS (SELECT db_id, operation, source_index, CAST('0x' || SUBSTR(sha256('42:' || source_index), 1, 15) AS BIGINT) AS number FROM cases),
 r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY db_id, operation ORDER BY number, source_index) AS place FROM n) SELECT db_id, operation, source_index FROM r WHERE place <= 20""",
)(lambda spark, d: sampling.bottom_k(fx.cases(spark, d).select("db_id", "operation", "source_index"), ["db_id", "operation"], ["source_index"], 20))
