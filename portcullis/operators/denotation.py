"""Whether two results are the same but for the order of their columns, for a whole table of cases at once.

Two results have the same denotation if some order of one's columns makes their rows equal, as bags or, where order
counts, as sequences. Trying orders one by one is a job each and there are factorially many; here columns get colours:

* a column's first colour is the bag of its cells (with their row numbers where order counts);
* a row's colour is the bag of its cells with their columns' colours, and a column's next one the bag of its cells with
  their rows' colours. Equal results have equal colours, whatever the order of their columns.

If the two sides' bags of column colours differ, so do the results. If a colour stands for one column only, or for columns
that are the same cell by cell, the colours give the order, and one exact comparison of rows under it decides. Where
different columns still share a colour, one column of the gold is given a colour of its own, each possible partner in
turn gets the same, and the colours are refined again. The first partner whose colours agree is followed; should the
exact comparison then fail, all partners are.

All cases take the same steps together: a few aggregations over their rows, whose number does not depend on how many
cases there are. Colours are 64-bit hashes of sums of hashes; a match always rests on the exact comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .. import steps

#: Rows of a case, of both results, up to which its rows are brought together; of larger ones only the sums of each task's rows are.
LARGE = 1 << 17
#: Hashes of cases by which their rows are counted first.
COUNTED = 1 << 16
#: Times colours are refined after a column got its own.
ROUNDS = 2

_COLUMNS = "array<struct<col:int,colour:bigint,content:bigint>>"


def normal_cell(c: Column, kind: T.DataType) -> Column:
    """A cell as text by which values of all types compare as values do: 1, 1.0 and TRUE are one, '1' is another, null is ''."""
    whole = F.concat(F.lit("n:"), c.cast("long").cast("string"))
    if isinstance(kind, T.BooleanType):
        out = F.concat(F.lit("n:"), c.cast("int").cast("string"))
    elif isinstance(kind, T.IntegralType):
        out = whole
    elif isinstance(kind, (T.FractionalType, T.DecimalType)):
        value = c.cast("double")
        out = F.when((F.abs(value) < 9.2e18) & (c == F.floor(c)), whole).otherwise(F.concat(F.lit("n:"), value.cast("string")))
    elif isinstance(kind, T.BinaryType):
        out = F.concat(F.lit("b:"), F.hex(c))
    elif isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        out = F.concat(F.lit("j:"), F.to_json(c))
    elif isinstance(kind, T.NullType):
        return F.lit("")
    else:  # text; dates and times as their text
        out = F.concat(F.lit("s:"), c.cast("string"))
    return F.coalesce(out, F.lit(""))


def result_rows(df: DataFrame, ordered: bool) -> DataFrame:
    """place and cells of each row of a result; columns go by number, so their names may repeat.

    With ``ordered``, places rise in the order in which df gives its rows (``ranked_places`` makes them numbers).
    """
    named = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    place = F.monotonically_increasing_id() if ordered else F.lit(None).cast("long")
    return named.select(place.alias("place"), F.array(*[normal_cell(F.col(f.name), f.dataType) for f in named.schema.fields]).alias("cells"))


def ranked_places(rows: DataFrame, key: str) -> DataFrame:
    """rows with places 0, 1, ... in each key's order: partitions are counted, so nothing is sorted again. Null places stay."""
    part = F.shiftright("place", 33)
    counts = rows.where("place is not null").groupBy(key, part.alias("_part")).agg(F.count("*").alias("_n"), F.min("place").alias("_least"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_part")) - F.col("_n")  # a row for each partition
    joined = rows.withColumn("_part", part).join(counts.select(key, "_part", (before - F.col("_least")).alias("_move")), [key, "_part"], "left")
    return joined.withColumn("place", F.col("place") + F.col("_move")).drop("_part", "_move")


def _bag(*parts: Column) -> Column:
    """Sum over rows of a hash of the parts: the same for the same bag of rows."""
    return _summed(F.xxhash64(*parts))


def _summed(h: Column) -> Column:
    """A hash of the sums of a hash's three pieces, which 2^41 rows do not overflow."""
    return F.xxhash64(F.sum(F.shiftright(h, 42)), F.sum(F.shiftright(h, 21).bitwiseAND(0x1FFFFF)), F.sum(h.bitwiseAND(0x1FFFFF)))


def _columns(rows: DataFrame, key: list[str], row_colour: Column) -> DataFrame:
    """For each key the columns' bags of cells with their rows' colours, beside the columns so far."""
    cells = rows.select(*key, F.explode(F.arrays_zip("cells", "columns")).alias("z"), row_colour.alias("_r"))
    summed = cells.groupBy(*key, F.col("z.columns.col").alias("col"), F.col("z.columns.colour").alias("old"), F.col("z.columns.content").alias("content")).agg(_bag(F.col("z.cells"), F.col("_r")).alias("new"))
    one = F.struct("col", F.xxhash64("old", "new").alias("colour"), "content")
    return summed.groupBy(*key).agg(F.array_sort(F.collect_list(one)).alias("columns"))


def _first(rows: DataFrame) -> DataFrame:
    """(case_id, g, p): each side's columns with their first colours, its number of rows, their bag and their least and most cells.

    Nothing is shuffled where rows are dealt by case_id; else the sums of each task's rows are.
    """
    # what is a row's own is worked out below the explode, so not once for each cell
    own = rows.select("case_id", "gold", "place", "_row", "cells", F.coalesce(F.size("cells"), F.lit(0)).alias("width"), F.xxhash64(F.sort_array("cells"), "place").alias("hash"))
    kept = own.select("case_id", "gold", "place", "_row", "width", "hash", F.posexplode_outer("cells").alias("col", "cell"))
    first = kept.groupBy("case_id", "gold", "col").agg(
        _bag(F.col("cell"), F.col("place")).alias("colour"), _bag(F.col("cell"), F.col("_row")).alias("content"),
        F.count("*").alias("n"), _summed(F.col("hash")).alias("bag"), F.min("width").alias("least"), F.max("width").alias("most"),
    )
    columns = F.array_sort(F.collect_list(F.struct("col", "colour", "content"))).cast(_COLUMNS).alias("columns")
    one = first.groupBy("case_id", "gold").agg(columns, F.max("n").alias("n"), F.max("bag").alias("bag"), F.min("least").alias("least"), F.max("most").alias("most"))
    side = lambda gold: F.max(F.when(F.col("gold") == F.lit(gold), F.struct("columns", "n", "bag", "least", "most")))
    return one.groupBy("case_id").agg(side(True).alias("g"), side(False).alias("p"))


def _refined(rows: DataFrame, state: DataFrame) -> DataFrame:
    """state (case_id, branch, g, p: the columns of both sides) with each side's colours refined ``ROUNDS`` times."""
    sides = state.select("case_id", "branch", F.explode(F.array(F.struct(F.lit(True).alias("gold"), F.col("g").alias("columns")), F.struct(F.lit(False).alias("gold"), F.col("p").alias("columns")))).alias("s")).select("case_id", "branch", "s.*")
    key = ["case_id", "branch", "gold"]
    for _ in range(ROUNDS):
        met = rows.join(sides, ["case_id", "gold"])
        colour = F.xxhash64(F.array_sort(F.transform(F.arrays_zip("cells", "columns"), lambda z: F.xxhash64(z["cells"], z["columns"]["colour"]))), F.col("place"))
        sides = _columns(met, key, colour)
    return _paired(sides, ["case_id", "branch"])


def _paired(sides: DataFrame, key: list[str]) -> DataFrame:
    side = lambda gold: F.max(F.when(F.col("gold") == F.lit(gold), F.col("columns")))
    return sides.groupBy(*key).agg(side(True).alias("g"), side(False).alias("p"))


def _colours(side: str) -> Column:
    return F.array_sort(F.transform(side, lambda c: c["colour"]))


#: Whether every colour of a side stands for one column, or for columns with the same cells.
_SETTLED = " and ".join(f"size(array_distinct(transform({s}, c -> c.colour))) = size(array_distinct(transform({s}, c -> struct(c.colour, c.content))))" for s in "gp")
#: Whether the sides have as many rows and columns, and the same bag of rows but for the order of cells.
_LIKE = "g.n = p.n and g.bag = p.bag and g.least > 0 and g.least = g.most and g.least = p.least and p.least = p.most"
#: The least colour of the gold that stands for different columns.
_OPEN = "array_min(transform(filter(g, x -> exists(g, y -> y.colour = x.colour and y.content <> x.content)), x -> x.colour))"


def _parted(state: DataFrame) -> DataFrame:
    """A branch for each partner of a column of the gold's open colour; both get a colour of their own, with the columns that are the same cell by cell."""
    opened = state.withColumn("k", F.expr(_OPEN)).withColumn("mine", F.expr("filter(g, c -> c.colour = k)[0].content"))
    partners = opened.withColumn("partner", F.explode(F.expr("array_distinct(transform(filter(p, c -> c.colour = k), c -> c.content))")))
    own = lambda side, content: F.expr(f"transform({side}, c -> named_struct('col', c.col, 'colour', if(c.colour = k and c.content = {content}, xxhash64(c.colour, 'own'), c.colour), 'content', c.content))")
    return partners.select("case_id", F.concat("branch", F.array("partner")).alias("branch"), own("g", "mine").alias("g"), own("p", "partner").alias("p"))


def _verified(rows: DataFrame, state: DataFrame) -> DataFrame:
    """The cases of which some branch's order makes the rows equal."""
    order = lambda side: F.transform(F.array_sort(F.transform(side, lambda c: F.struct(c["colour"], c["col"]))), lambda c: c["col"])
    met = rows.join(state.select("case_id", "branch", order("g").alias("go"), order("p").alias("po")), "case_id")
    laid = met.select("case_id", "branch", "place", "gold", F.transform(F.when(F.col("gold"), F.col("go")).otherwise(F.col("po")), lambda i: F.element_at("cells", i + 1)).alias("cells"))
    counts = laid.groupBy("case_id", "branch", "place", "cells").agg(F.sum(F.when(F.col("gold"), 1).otherwise(-1)).alias("n"))
    return counts.groupBy("case_id", "branch").agg(F.max(F.abs("n")).alias("n")).where("n = 0").select("case_id").distinct()


def _searched(rows: DataFrame, open_: DataFrame, every: bool) -> DataFrame:
    """The open cases that match. Each round settles those whose colours now do and gives the others' next column a colour."""
    found, made, state = [], [], open_
    while True:
        state = _refined(rows, _parted(state)).where(_colours("g") == _colours("p"))
        if not every:
            state = state.groupBy("case_id").agg(F.min_by(F.struct("branch", "g", "p"), "branch").alias("s")).select("case_id", "s.*")
        state = steps.written(state)
        made.append(state)
        found.append(_verified(rows, state.where(_SETTLED)))
        state = state.where(f"not ({_SETTLED})")
        if state.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    out = steps.written(out.distinct())
    steps.release(*made)
    return out


def _large(rows: DataFrame) -> DataFrame | None:
    """The cases of more than ``LARGE`` rows, written; None without any. Cases are counted one by one only where their hashes crowd."""
    place = F.pmod(F.xxhash64("case_id"), F.lit(COUNTED))
    crowded = steps.written(rows.groupBy(place.alias("_at")).agg(F.count("*").alias("n")).where(F.col("n") > LARGE).select("_at"))
    large = None
    if not crowded.isEmpty():
        few = rows.select("case_id").withColumn("_at", place).join(F.broadcast(crowded), "_at", "left_semi")
        large = steps.written(few.groupBy("case_id").agg(F.count("*").alias("n")).where(F.col("n") > LARGE).select("case_id"))
        if large.isEmpty():
            steps.release(large)
            large = None
    steps.release(crowded)
    return large


def _told(rows: DataFrame) -> DataFrame:
    """(case_id, open, good) of each case, by first colours alone: whether they leave it open, and whether it matches.

    rows are dealt by case_id. They are read twice where they are, first for the colours and then, laid out by them, for the
    exact comparison, so nothing but what deals them is shuffled. The colours' side is hashed, so no rows are sorted.
    """
    sides = _first(rows.withColumn("_row", F.monotonically_increasing_id()))
    pairs = sides.select("case_id", F.coalesce(F.expr(_LIKE), F.lit(False)).alias("like"), F.col("g.columns").alias("g"), F.col("p.columns").alias("p"))
    agreed = F.col("like") & (_colours("g") == _colours("p"))
    sure = pairs.select("case_id", F.when(agreed, F.expr(_SETTLED)).alias("sure"), "g", "p")  # null where colours differ
    ranked = lambda side: F.transform(F.array_sort(F.transform(side, lambda c: F.struct(c["colour"], c["col"]))), lambda c: c["col"])
    partners = F.transform(F.array_sort(F.zip_with(ranked("g"), ranked("p"), lambda g, p: F.struct(g.alias("g"), p.alias("p")))), lambda z: z["p"])
    state = sure.select("case_id", F.coalesce(F.col("sure"), F.lit(False)).alias("check"), F.coalesce(~F.col("sure"), F.lit(False)).alias("open"), F.when(F.col("sure"), partners).alias("partners"))
    met = rows.join(state.hint("shuffle_hash"), "case_id")
    laid = F.when(F.col("gold"), F.col("cells")).otherwise(F.transform("partners", lambda i: F.element_at("cells", i + 1)))
    sign = F.when(F.col("gold"), 1).otherwise(-1).alias("sign")
    # the rows of a case that is not compared count as one
    counts = met.select("case_id", "check", "open", F.when(F.col("check"), F.col("place")).alias("place"), F.when(F.col("check"), laid).alias("cells"), sign).groupBy("case_id", "check", "open", "place", "cells").agg(F.sum("sign").alias("n"))
    return counts.groupBy("case_id").agg(F.bool_or("open").alias("open"), F.bool_and(F.col("check") & (F.col("n") == 0)).alias("good"))


def denotation_equal(rows: DataFrame, cases: DataFrame, dealt: bool = False) -> DataFrame:
    """(case_id, matches) for each row of ``cases``: whether the case's two results have the same denotation.

    rows has a row for each row of a result: case_id, gold (whether it is of the gold's result), place (its number where
    order counts, else null) and cells (``normal_cell``). Both results empty match, however many columns they have; one
    empty does not. Different numbers of rows or columns do not match. Cases without rows on either side match; null
    cells equal each other. With ``dealt`` the plan of rows has already brought each case's rows together by case_id (a
    window over it, say), and they are not dealt again.

    Rows are written only of large cases and of those that the first colours leave open.
    """
    rows = rows.select("case_id", "gold", "place", "cells").where("case_id is not null")
    large = _large(rows)
    small = rows if large is None else rows.join(F.broadcast(large), "case_id", "left_anti")  # at most a row for each LARGE rows
    told = steps.written(_told(small if dealt else small.repartition("case_id")))
    verdicts, made = told.select("case_id", "good"), [told]
    left = told.where("open").select("case_id")
    if large is not None:
        left = left.unionByName(large)
        verdicts = verdicts.unionByName(large.withColumn("good", F.lit(False)))
        made.append(large)
    if not left.isEmpty():
        held = steps.written(rows.join(left, "case_id", "left_semi").withColumn("_row", F.monotonically_increasing_id()))
        good = _found(held, large)
        verdicts = verdicts.unionByName(good.withColumn("good", F.lit(True)))
        made += [held, good]
    best = verdicts.groupBy("case_id").agg(F.bool_or("good").alias("good"))
    out = steps.written(cases.select("case_id").join(best, "case_id", "left").select("case_id", F.coalesce("good", F.lit(True)).alias("matches")))
    steps.release(*made)
    return out


def _found(rows: DataFrame, large: DataFrame | None) -> DataFrame:
    """The cases of written rows that match; those of ``large`` are not brought together."""
    if large is None:
        sides = _first(rows.repartition("case_id"))
    else:
        few = F.broadcast(large)
        sides = _first(rows.join(few, "case_id", "left_anti").repartition("case_id")).unionByName(_first(rows.join(few, "case_id", "left_semi")))
    pairs = sides.where(_LIKE).select("case_id", F.array().cast("array<bigint>").alias("branch"), F.col("g.columns").alias("g"), F.col("p.columns").alias("p"))
    state = steps.written(pairs.where(_colours("g") == _colours("p")))
    # refined once where needed, before any column is given a colour
    rest = state.where(f"not ({_SETTLED})")
    good = _verified(rows, state.where(_SETTLED))
    made = [state]
    if not rest.isEmpty():
        refined = steps.written(_refined(rows, rest).where(_colours("g") == _colours("p")))
        good = good.unionByName(_verified(rows, refined.where(_SETTLED)))
        open_ = refined.where(f"not ({_SETTLED})")
        made.append(refined)
        if not open_.isEmpty():
            one = _searched(rows, open_, every=False)
            left = steps.written(open_.join(one, "case_id", "left_anti"))
            good = good.unionByName(one)
            made += [one, left]
            if not left.isEmpty():
                every = _searched(rows, left, every=True)
                good = good.unionByName(every)
                made.append(every)
    out = steps.written(good)
    steps.release(*made)
    return out
