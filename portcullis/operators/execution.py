"""Running statements against databases of Parquet tables, and judging answers by their results."""

from __future__ import annotations

import itertools
import json
import re
import threading
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import steps
from ..functions import scanning
from ..plans import sqlfront
from . import denotation

#: Operations that change a database, and what a query may begin with or contain none of.
WRITES = frozenset({"INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP", "MERGE", "REPLACE", "TRUNCATE", "CALL", "DO", "SET", "GRANT", "REVOKE", "INTO"})
READS = frozenset({"SELECT", "WITH", "VALUES", "("})
#: Functions that call code outside SQL.
JAVA = frozenset({"JAVA_METHOD", "REFLECT", "TRY_REFLECT"})

#: The functions that a statement may call. All of them only compute from their arguments.
FUNCTIONS = frozenset(
    """
    abs array array_contains array_distinct array_join array_max array_min array_position array_size avg between cardinality cast ceil ceiling char char_length character_length chr coalesce
    collect_list collect_set concat concat_ws contains cos count count_if current_date current_timestamp date date_add date_diff date_format date_part date_sub date_trunc dateadd datediff day
    dayofmonth dayofweek dayofyear dense_rank element_at endswith exists exp explode explode_outer extract filter first first_value floor format_number from_json from_unixtime get_json_object
    greatest group_concat grouping hour if ifnull in initcap instr isnotnull isnull lag last last_day last_value lcase lead least left len length levenshtein like ln locate log log10 log2
    lower lpad ltrim map map_keys map_values max max_by md5 mean median min min_by minute mod mode month months_between named_struct next_day not now ntile nth_value nullif nvl nvl2
    percent_rank percentile pi position posexplode pow power quarter rand range rank regexp_count regexp_extract regexp_like regexp_replace regexp_substr repeat replace reverse right rint
    round row_number rpad rtrim second sequence sha1 sha2 sign signum sin size slice some sort_array split split_part sqrt startswith std stddev stddev_pop stddev_samp string_agg struct
    substr substring sum tan to_date to_json to_number to_timestamp transform translate trim trunc try_divide typeof ucase unix_timestamp upper var_pop var_samp variance weekday year
    """.split()
)


def read_only(sql: str | None) -> bool:
    """Whether a text is one query that writes nothing, takes no locks, reads no path and calls no Java; what cannot be read is not.

    It goes by tokens, so that tables of statements can be judged anywhere; ``refusal`` also asks Catalyst and the database.
    """
    try:
        statements = [s for s in sqlfront.split(sql or "") if s.strip()]
        if len(statements) != 1:
            return False
        tokens = sqlfront.tokenize(statements[0])
    except (sqlfront.Unsupported, ValueError):
        return False
    words = [t.text.upper() for t in tokens if t.kind == "word" or t.text == "("]
    if not words or words[0] not in READS:
        return False
    locks = any(a == "FOR" and b in ("UPDATE", "SHARE", "NO", "KEY") for a, b in itertools.pairwise(words))
    paths = any(a.text.upper() in ("FROM", "JOIN", ",") and b.kind in ("word", "name") and c.text == "." and e.kind == "name" and "/" in e.text for a, b, c, e in zip(tokens, tokens[1:], tokens[2:], tokens[3:], strict=False))
    calls = {a for a, b in itertools.pairwise(words) if b == "("}  # REPLACE(x, y, z) is a function
    outside = {w for w in calls if w in JAVA}
    return not locks and not paths and not outside and not any(w in WRITES and w not in calls for w in words)


@F.pandas_udf(T.BooleanType())
def is_read_only(sql: pd.Series) -> pd.Series:
    return sql.map(read_only)


def open_database(spark: SparkSession, tables: dict[str, str]) -> SparkSession:
    """A session of its own, in which each Parquet path is a view; ``execute`` lets statements see these views only."""
    session = spark.newSession()
    for name, path in tables.items():
        session.read.parquet(path).createOrReplaceTempView(name)
    session.views = frozenset(name.lower() for name in tables)
    return session


#: Nodes of Catalyst's parsed plans that only compute, and nodes of its analysis that only name something.
_PLANS = frozenset(
    "Aggregate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation OneRowRelation$ Pivot PipeOperator Project Sample Sort SubqueryAlias Tail Union"
    " UnresolvedHint UnresolvedWith Unpivot Window WithWindowDefinition WithCTE Deduplicate".split()
)
_NAMED = frozenset(
    "UnresolvedAlias UnresolvedAttribute UnresolvedDeserializer UnresolvedExtractValue UnresolvedFunction UnresolvedGenerator UnresolvedHaving UnresolvedInlineTable UnresolvedOrdinal UnresolvedRegex UnresolvedRelation UnresolvedStar"
    " UnresolvedSubquery UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction MultiAlias NamedParameter PosParameter UnresolvedStarExceptOrReplace UnresolvedStarWithColumns UnresolvedTVFAliases UnresolvedWindowExpression".split()
)


def refusal(session: SparkSession, sql: str) -> str | None:
    """Why a statement may not run, or None: by Catalyst's parsed plan, before any name in it is looked up.

    A statement may read the database's views and its own common tables, and call functions of ``FUNCTIONS``: no path, no
    other session's or catalogue's table, no script, no call of Java.
    """
    if not read_only(sql):
        return "not a query"
    try:
        nodes = json.loads(session._jsparkSession.sessionState().sqlParser().parsePlan(sql).toJSON())
    except PySparkException as e:
        return str(e).splitlines()[0]
    views, stack = getattr(session, "views", frozenset()), [nodes]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            stack += node
        if not isinstance(node, dict):
            continue
        stack += node.values()
        package, _, kind = str(node.get("class", "")).rpartition(".")
        if not kind:
            continue
        said = node.get("nameParts") or node.get("multipartIdentifier") or node.get("name")
        parts = [x.strip() for x in said.strip("[]").split(",")] if isinstance(said, str) else [str((said or {}).get("funcName", ""))] if isinstance(said, dict) else []
        if kind in ("UnresolvedFunction", "UnresolvedGenerator", "UnresolvedTableValuedFunction"):
            if len(parts) != 1 or parts[0].lower() not in FUNCTIONS:
                return f"function {'.'.join(parts)} is not allowed"
        elif kind == "UnresolvedRelation":
            # a name that is no view must be a common table's: what the catalogue knows otherwise is refused
            if len(parts) != 1 or parts[0].lower() not in views and session.catalog.tableExists(parts[0]):
                return f"no table {'.'.join(parts)} in this database"
        elif (package.endswith("plans.logical") and kind not in _PLANS) or (package.endswith("catalyst.analysis") and kind not in _NAMED and not kind.endswith("$")) or not package.startswith("org.apache.spark.sql.catalyst."):
            return f"{kind} is not allowed"
    return None


def limited(spark: SparkSession, seconds: float, run: Callable[[], object]) -> str:
    """'ok', 'error' where Spark refuses it, or 'timeout' where its jobs take longer and are cancelled."""
    tag, context, late = f"limited-{uuid.uuid4().hex}", spark.sparkContext, threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    context.addJobTag(tag)
    timer.start()
    try:
        run()
    except PySparkException:
        return "timeout" if late.is_set() else "error"
    except Exception as e:  # a cancelled job may come back as the gateway's error
        if late.is_set() or "SparkException" in str(e):
            return "timeout" if late.is_set() else "error"
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)
    return "ok"


@dataclass(frozen=True)
class Ran:
    """What a list of statements gave: the last result, if any, or the first error."""

    result: DataFrame | None = None
    error: str | None = None


def execute(session: SparkSession, statements: list[str]) -> Ran:
    """Plans the statements in turn; the last result counts. Only queries over the database's views are run: others are errors."""
    result = None
    for sql in statements:
        if why := refusal(session, sql):
            return Ran(error=why)
        try:
            result = session.sql(sql)
        except PySparkException as e:
            return Ran(error=str(e).splitlines()[0])
    return Ran(result=result)


def numbered(df: DataFrame) -> DataFrame:
    """df, written once, with each row's place in its order as first column."""
    marked = steps.written(df.select(F.lit(0).alias("_all"), F.monotonically_increasing_id().alias("place"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]))
    return denotation.ranked_places(marked, "_all").select(F.col("place").alias("_place"), *[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)])


@dataclass(frozen=True)
class Pair:
    """A prediction and its gold over the databases that both are run on."""

    databases: tuple[SparkSession, ...]
    predicted: str
    gold: str


def tidied(sql: str, keep_distinct: bool = False) -> str:
    """Comparisons that were split are joined, the current year is 2020 and, unless kept, the word DISTINCT goes wherever it is one."""
    for wide, close in (("> =", ">="), ("< =", "<="), ("! =", "!=")):
        sql = sql.replace(wide, close)
    sql = re.sub(r"YEAR\s*\(\s*CURDATE\s*\(\s*\)\s*\)", "2020", sql, flags=re.IGNORECASE)
    return sql if keep_distinct else scanning.without_distinct(sql)


class _Results:
    """Results of statements as written rows, each run once."""

    def __init__(self, spark: SparkSession, seconds: float) -> None:
        self.spark, self.seconds, self.base = spark, seconds, f"{steps.shared_folder(spark)}/{uuid.uuid4().hex}"
        self.known: dict[tuple[int, str, bool], tuple[str, int]] = {}

    def run(self, session: SparkSession, sql: str, ordered: bool) -> tuple[str, int]:
        """Outcome ('ok', 'error' or 'timeout') and the number under which the rows are kept."""
        key = (id(session), sql, ordered)
        if key not in self.known:
            number, ran = len(self.known), execute(session, [sql])
            outcome = "error"
            if ran.error is None:
                rows = denotation.result_rows(ran.result, ordered).select(F.lit(number).alias("result"), "*")
                outcome = limited(self.spark, self.seconds, lambda: rows.write.parquet(f"{self.base}/{number}"))
            self.known[key] = outcome, number
        return self.known[key]

    def rows(self) -> DataFrame | None:
        kept = [n for outcome, n in self.known.values() if outcome == "ok"]
        if not kept:
            return None
        read = self.spark.read.schema("result int, place long, cells array<string>").parquet(*[f"{self.base}/{n}" for n in kept])
        return denotation.ranked_places(read, "result")

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def exec_verdicts(spark: SparkSession, pairs: list[Pair], keep_distinct: bool = False, plug: bool = False, seconds: float = 30.0) -> list[str]:
    """For each pair 'match', 'differs', 'error' (the prediction cannot run), 'timeout' or 'gold' (the gold cannot run).

    A prediction matches if it, or with ``plug`` it with the gold's values in its slots, gives the gold's result on all its
    databases; order of rows counts where the gold sorts. Each statement is run once, within ``seconds``; results are then
    compared together, in a number of jobs that does not depend on how many there are, without a limit of time. With
    ``plug`` candidates are taken one at a time, all pairs' together, until one matches; there are as many as values of
    the gold to the power of slots.
    """
    verdicts: list[str | None] = [None] * len(pairs)
    tidy = [(tidied(p.predicted, keep_distinct), tidied(p.gold, keep_distinct)) for p in pairs]
    candidates = [itertools.chain([p], plugged(p, g) if plug else ()) for p, g in tidy]
    results = _Results(spark, seconds)
    last: list[str] = ["differs"] * len(pairs)
    try:
        while any(v is None for v in verdicts):
            met: list[tuple[int, bool, int]] = []  # attempt, of the gold, result
            attempts: list[int] = []  # the attempts' pairs
            waiting: set[int] = set()
            for i, pair in enumerate(pairs):
                if verdicts[i] is not None:
                    continue
                sql, gold = next(candidates[i], None), tidy[i][1]
                if sql is None:
                    verdicts[i] = last[i]
                    continue
                ordered, mine = "order by" in gold.lower(), []
                for session in pair.databases:
                    want = results.run(session, gold, ordered)
                    if want[0] != "ok":
                        verdicts[i] = "gold"
                        break
                    got = results.run(session, sql, ordered)
                    last[i] = "differs" if got[0] == "ok" else got[0]
                    if got[0] != "ok":
                        break
                    mine.append((want[1], got[1]))
                else:
                    waiting.add(i)
                    for want_at, got_at in mine:
                        met += [(len(attempts), True, want_at), (len(attempts), False, got_at)]
                        attempts.append(i)
            failed: set[int] = set()
            if attempts:
                asked = spark.createDataFrame(met, "case_id int, gold boolean, result int")
                rows = asked.join(results.rows(), "result").select("case_id", "gold", "place", "cells")
                found = denotation.denotation_equal(rows, spark.range(len(attempts)).select(F.col("id").cast("int").alias("case_id")))
                failed = {attempts[r["case_id"]] for r in found.where("not matches").collect()}  # as many as statements were given
                steps.release(found)
            for i in waiting - failed:
                verdicts[i] = "match"
    finally:
        results.drop()
    return [v or "differs" for v in verdicts]


def exec_match(databases: list[SparkSession], predicted: str, gold: str, keep_distinct: bool = False, plug: bool = False, seconds: float = 30.0) -> bool:
    """Whether one prediction matches (``exec_verdicts``). A gold that cannot be run is an error, a prediction that cannot is no match."""
    verdict = exec_verdicts(databases[0], [Pair(tuple(databases), predicted, gold)], keep_distinct, plug, seconds)[0]
    if verdict == "gold":
        raise ValueError("the gold statement cannot be run")
    return verdict == "match"


def plugged(predicted: str, gold: str) -> Iterator[str]:
    """The prediction with each of its literals replaced by each of the gold's, in all ways, one at a time."""
    values = sorted(set(scanning.literals(gold)))
    pieces, at = [], 0
    for found in scanning.literals(predicted):
        start = re.compile(rf"(?<![\w.]){re.escape(found)}" if found[0].isdigit() else re.escape(found)).search(predicted, at).start()
        pieces.append(predicted[at:start])
        at = start + len(found)
    for chosen in itertools.product(values, repeat=len(pieces)):
        yield "".join(x for pair in zip(pieces, chosen, strict=True) for x in pair) + predicted[at:]


def live_verdicts(cases: DataFrame, predicted: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """(key, matches) for every case: whether its rows of both tables are equal as sets, all cases in one aggregation.

    The tables have one row a result row: key and cells (``equivalence.canonical`` makes them comparable). Both empty
    match, one empty does not.
    """
    cells = [c for c in gold.columns if c != key]
    both = predicted.select(key, *cells).withColumn("_p", F.lit(1)).unionByName(gold.withColumn("_p", F.lit(0)))
    rows = both.groupBy(key, *cells).agg(F.max("_p").alias("p"), F.min("_p").alias("g"))
    differ = rows.where("p = 0 or g = 1").select(F.col(key).alias("_k")).distinct()
    names = cases.select(key).distinct()
    return names.join(differ, F.col(key).eqNullSafe(F.col("_k")), "left").select(key, F.col("_k").isNull().alias("matches"))


def unordered_cells(df: DataFrame) -> DataFrame:
    """Each row as its cells sorted by text and type, so that rows compare without the order of columns."""
    cells = [F.when(F.col(f"`{f.name}`").isNull(), "None").otherwise(F.concat(F.col(f"`{f.name}`").cast("string"), F.lit(f":{f.dataType.simpleString()}"))) for f in df.schema.fields]
    return df.select(F.array_sort(F.array(*cells)).alias("cells"))


def sample_class(allowed: Column, has_gold: Column, refused: Column, has_sql: Column, ran: Column, matched: Column, managing: Column, dry_run: bool = False) -> Column:
    """(classification, error) of one CRUD answer: managing statements succeed if they ran, queries if their results match."""
    good = F.coalesce(F.when(managing, ran).otherwise(ran & matched), F.lit(False))
    right, wrong = F.when(allowed, "correct").otherwise("violation_correct"), F.when(allowed, "wrong").otherwise("violation_wrong")
    error = F.when(allowed & ~has_gold, "missing_gold_sql").when(refused, F.lit(None)).when(~has_sql, "empty_sql")
    error = error.when(F.lit(dry_run), "dry_run") if dry_run else error
    refusal = F.when(allowed, "incorrect_refusal").otherwise("correct_refusal")
    return F.struct(F.when(error.isNotNull(), wrong).when(refused, refusal).when(good, right).otherwise(wrong).alias("classification"), error.alias("error"))
