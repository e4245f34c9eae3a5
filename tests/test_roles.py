"""Written roles against a plain line-by-line reading."""

import random
import re

from pyspark.sql import functions as F

from portcullis.functions import roles


def clean(x):
    return re.sub(r"\s+", " ", re.sub(r"[*`\[\]'\"]", "", x)).strip()


def read(text, valid):
    out, now = [], None

    def end(mark):
        nonlocal now
        whole = now is not None and len(now) == 3
        if whole:
            role, description, tables = clean(re.split(r"\s*[-–]\s*", now["role"], maxsplit=1)[0]), clean(now["description"]), clean(now["tables"])
            unknown = sorted({t.strip().lower() for t in tables.split(",")} - set(valid)) if mark and valid else []
            if role and description and tables:
                out.append((role, description, tables + (f" NEED HUMAN VERIFICATION (Invalid tables: {', '.join(unknown)})" if unknown else "")))
        return whole

    for line in text.strip().split("\n"):
        line = line.strip()
        if not line:
            now = None if end(True) else now
        elif re.search("ROLE[:：]", line.upper()):
            end(False)
            now = {"role": re.split("(?i)ROLE[:：]", line)[-1].strip()}
        elif now is not None:
            for name in ("DESCRIPTION", "TABLES"):
                if re.match(f"{name}[:：]", line.upper()):
                    now[name.lower()] = re.split(f"(?i){name}[:：]", line)[-1].strip()
                    break
            else:
                if not re.search("(ROLE|DESCRIPTION|TABLES):", line.upper()):
                    now["role"] += " " + line
    end(True)
    return out


PARTS = ["ROLE: Boss", "**Role:** *Clerk* - sells", "role： x–y", "DESCRIPTION: a `b`  c", "Description：", "TABLES: t, U ,zz", "Tables: [t]", "tables: 't'", "of  the firm", "see TABLES: t", "", "", "  ", "- DESCRIPTION: q", "ROLE:", "ROLE: a ROLE: b"]


def test_table_roles(spark):
    r = random.Random(12)
    texts = ["\n".join(r.choice(PARTS) for _ in range(r.randint(0, 14))) for _ in range(600)] + ["", "ROLE: a\r\nDESCRIPTION: b\r\nTABLES: t\r\n"]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, t string").repartition(3)
    for valid in (["t", "u"], []):
        known = F.array(*[F.lit(x) for x in valid]).cast("array<string>")
        got = {x.i: x.r and [tuple(y) for y in x.r] for x in df.select("i", roles.table_roles(F.col("t"), known).alias("r")).collect()}
        assert got[-1] is None
        for i, t in enumerate(texts):
            assert got[i] == read(t, valid), t
    assert sum(map(bool, got.values())) > 30
    free = {x.i: [tuple(y) for y in x.r] for x in df.where("i >= 0").select("i", roles.table_roles(F.col("t")).alias("r")).collect()}
    assert all(free[i] == read(t, []) for i, t in enumerate(texts))


def test_a_table_named_twice_keeps_its_last_list(spark):
    texts = ["ROLE: a\nDESCRIPTION: b\nCOLUMNS:\nt: x, y\nu: q\nt: z\n", '```json\n[{"role": "a", "description": "b", "columns": {"t": ["x"], "u": ["q"], "t": ["z"]}}]\n```', '[{"role": "a", "description": "b", "columns": null}]']
    got = [r.r for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(roles.column_roles(F.col("t")).alias("r")).collect()]
    assert [[x.columns for x in r] for r in got] == [[{"t": ["z"], "u": ["q"]}], [{"t": ["z"], "u": ["q"]}], [None]]
