"""Items of any layout, detected keys, ground truth, and description files of unknown encodings."""

import json

import pytest

from portcullis.sources import items, records

LEVEL = {"instruction": "i", "input": "q", "role": "r", "policy": {"t": ["c", "*"]}, "database": "d", "difficulty": "hard", "metadata": {"permission": "denied", "gold_sql": " select 1", "a.b": 1}}
CRUD = {"id": 7, "db_id": "d", "database": "no", "allowed": False, "gold_output": "UPDATE t SET x = 1", "category": "Management", "policy": None}


@pytest.mark.parametrize("suffix", ["json", "jsonl"])
def test_three_layouts(spark, tmp_path, suffix):
    def load(dataset, rows, **more):
        path = tmp_path / f"{dataset}.{suffix}"
        path.write_text(json.dumps(rows) if suffix == "json" else "\n".join(map(json.dumps, rows)) + "\n\n")
        return items.load_items(spark, str(path), dataset, **more).orderBy("source_index").collect()

    a, b, c = load("spider", [LEVEL, {}, {"metadata": {"permission": ""}, "id": "x"}])
    assert (a.id, a.gold_sql, a.is_allowed, a.operation, a.difficulty, a.database, json.loads(a.policy)) == ("spider_0", " select 1", False, "SELECT", "hard", "d", {"t": ["c", "*"]})
    assert json.loads(a.metadata)["a.b"] == 1
    assert (b.id, b.gold_sql, b.is_allowed, b.operation, b.difficulty, b.policy, b.input, b.metadata) == ("spider_1", "", True, "OTHER", None, "{}", "", None)
    assert (c.id, c.is_allowed) == ("x", True)
    (a, b) = load("livesqlbench", [CRUD, {"allowed": True, "gold_sql": "DROP TABLE t"}])
    assert (a.id, a.gold_sql, a.is_allowed, a.operation, a.category, a.database, a.policy) == ("7", "UPDATE t SET x = 1", False, "UPDATE", "Management", "d", "{}")
    assert (b.id, b.is_allowed, b.operation) == ("livesqlbench_1", True, "DROP")
    assert len(load("bird", [LEVEL] * 5, max_samples=2)) == 2
    with pytest.raises(ValueError, match="unknown dataset"):
        items.layout("none")


def test_keys_and_ground_truth(spark):
    texts = lambda *rows: spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "source_index long, record string")
    assert items.detected_keys(texts({"question_id": 1, "id": 2, "query": "a", "sql": "b"}, {"instance_id": 3})) == ("id", "sql")
    assert items.detected_keys(texts({"x": 1})) == (None, None) and items.detected_keys(texts({"x": 1}), "x", "y") == ("x", "y")
    got = items.ground_truth(texts({"instance_id": "a", "sql": ["SELECT 1", "SELECT 2"]}, {"instance_id": "b", "sql": "old"}, {"instance_id": "b", "sql": "new"}, {"sql": "no id"}))
    assert {r.instance_id: r.gold_sql for r in got.collect()} == {"a": "SELECT 1", "b": "new"}
    with pytest.raises(ValueError, match="no known key"):
        items.ground_truth(texts({"x": 1}))
    assert items.record_schema(texts({"a": 1}, {"a": "x", "b": [1.5]})).startswith("OBJECT<a: VARIANT, b: ARRAY<")


def test_descriptions_in_three_encodings(spark, tmp_path):
    head = "original_column_name,column_name,column_description,data_format,value_description\n"
    body = {"one": ("id,Número,Größe “x”,text,\n", "utf-8-sig"), "two": ("id,Número,Größe,text,\"a,\nb\"\n\n", "latin-1"), "three": ("id,caf\x92s,x,text,y\nid2,b,c,d,e\n", "latin-1")}
    for name, (text, encoding) in body.items():
        (tmp_path / f"{name}.csv").write_bytes((head + text).encode(encoding))
    got = {(r.table_name, r.place): r for r in records.descriptions(spark, str(tmp_path)).collect()}
    assert sorted(got) == [("one", 0), ("three", 0), ("three", 1), ("two", 0)]
    assert (got["one", 0].encoding, got["one", 0].column_description, got["one", 0].value_description) == ("utf-8", "Größe “x”", None)
    assert (got["two", 0].encoding, got["two", 0].column_name, got["two", 0].value_description) == ("latin-1", "Número", "a,\nb")
    strict = {(r.table_name, r.encoding, r.column_name) for r in records.descriptions(spark, str(tmp_path), ("utf-8", "cp1252")).collect()}
    assert ("three", "cp1252", "caf’s") in strict
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(Exception, match="missing columns"):
        records.descriptions(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="no encoding"):
        records.descriptions(spark, str(tmp_path / "two.csv"), ("utf-8",)).collect()
