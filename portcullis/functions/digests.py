"""Digests of JSON records: SHA-256 of their canonical text, the same for the same record however it was written."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What the canonical text writes unlike Spark's own: numbers with a fraction or an exponent, and control characters as ``\u00..``.
_ODD = r"[0-9][.eE]|\\u00[01]"


@F.pandas_udf(T.StringType())
def _rewritten(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield pd.Series([None if x is None else json.dumps(json.loads(x), ensure_ascii=False, sort_keys=True, separators=(",", ":")) for x in part], dtype=object)


def canonical_json(text: Column) -> Column:
    """A JSON text with its keys in order and no white space, as ``json.dumps(sort_keys=True, separators=(",", ":"), ensure_ascii=False)`` writes it.

    Null gives null, and text that is no JSON, or repeats a key of one object, is an error. Variants sort and write in the
    JVM; texts that may hold a float or a control character are also read in Python, which spells those its own way.
    """
    odd = text.rlike(_ODD)
    return F.when(odd, _rewritten(F.when(odd, text))).otherwise(F.to_json(F.parse_json(text)))


def digest(text: Column) -> Column:
    return F.sha2(canonical_json(text), 256)


def canonical_gold(record: Column) -> Column:
    """The gold statement of a JSON record: the first of its names that is not empty."""
    given = [F.nullif(F.get_json_object(record, p), F.lit("")) for p in ("$.gold_sql", "$.metadata.gold_sql")]
    return F.coalesce(*given, F.get_json_object(record, "$.output"), F.lit(""))
