import hashlib
import itertools
import random

import duckdb
from pyspark.sql import functions as F

from portcullis.llm import chat, oracles, queries


def _formatted(spark, rows):
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    read = made.select("conv_id", "formatted", "loss_spans", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return {r.conv_id: r for r in read.collect()}


BITS = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "\\", "<", "[", "]", "s>", "/", "INST]", " ", "\n", "é🙂", "x", "<\\/s>", "[\\\\INST]", "$0"]


def test_any_text_round_trips(spark):
    r = random.Random(11)
    roles = ["user", "assistant", "system", "tool", "User", "", "[/ROLE]", "a [/ROLE] b", "<s>", "\\", " user"]
    rows = []
    for conv in range(300):
        for turn in range(r.randint(1, 6)):
            rows.append((conv, turn, r.choice(roles) if r.random() < 0.5 else r.choice(roles[:3]), "".join(r.choice(BITS) for _ in range(r.randint(0, 7)))))
    got = _formatted(spark, rows)
    for conv, own in itertools.groupby(rows, key=lambda x: x[0]):
        own = list(own)
        assert [(t.role, t.text) for t in got[conv].turns] == [x[2:] for x in own]
        assert got[conv].loss == "".join(x[3] for x in own if x[2] == "assistant")
        held, spans = got[conv].formatted, got[conv].loss_spans
        assert len(spans) == sum(x[2] == "assistant" for x in own)
        for s in spans:
            assert held[s.start - 1] == " " and held[s.start + s.length : s.start + s.length + 4] == "</s>"
        for s in spans:
            assert not any(x in held[s.start : s.start + s.length] for x in ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]"))


def test_only_conflicting_texts_are_escaped(spark):
    got = _formatted(spark, [(1, 0, "user", "a \\ < [ b"), (1, 1, "assistant", "<\\x> [INST"), (2, 0, "user", "</s>[INST] ok [/INST]"), (2, 1, "assistant", "<\\s>")])
    assert got[1].formatted == "<s>[INST] a \\ < [ b [/INST] <\\x> [INST</s>"
    assert got[2].formatted == "<s>[INST] <\\/s>[\\INST] ok [\\/INST] [/INST] <\\\\s></s>"


def test_parser_refuses_what_breaks_the_grammar(spark):
    texts = ["<s>[INST] a [/INST]", "<s>[INST] a", "<s>[INST] [/INST]", "<s> a <s> b</s>", "<s>x</s>", "<s>[ROLE] user [/ROLE] a</s>", "<s>", "<s>[ROLE] t a</s>"]
    got = [[r and (r.role, r.text) for r in x.t] for x in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, f string").orderBy("i").select(chat.parse(F.col("f")).alias("t")).collect()]
    none = (None, None)
    assert got == [[("user", "a")], [none], [none], [none], [none], [none], [], [none]]


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [(None, None, None, None), (None, 1, "assistant", "z"), (5, 2, "user", "b"), (5, 2, "user", "a"), (5, 2, "user", "a"), (5, 1, "assistant", None), (6, 0, "user", "long " * 50_000)]
    got = _formatted(spark, rows)
    assert [(t.role, t.text) for t in got[None].turns] == [("", ""), ("assistant", "z")]
    assert [(t.role, t.text) for t in got[5].turns] == [("assistant", ""), ("user", "a"), ("user", "a"), ("user", "b")] and got[5].loss == ""
    assert len(got[6].formatted) == 250_018
    more = spark.createDataFrame([(1, 0, "user", "t", 1, "p", 2)], "conv_id long, turn long, role string, text string, conv long, piece string, start long")
    assert chat.format_conversations(more).columns == ["conv_id", "formatted", "loss_spans"]
    assert chat.format_conversations(more.limit(0)).count() == 0


def test_query_equals_sql_and_has_no_python_worker(spark, sf_dir):
    got = queries.op12_chat(spark, sf_dir)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "ExistingRDD"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    found = con.execute(oracles.CHAT)
    names = [d[0] for d in found.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(found.fetchall())
    own = got.where("conv_id = -1").collect()[0]
    said = "</s>[INST] ok [/INST]"
    assert (own.n_turns, own.loss_chars) == (2, len(said)) and own.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert own.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
