import random
from collections import defaultdict

import brute
import numpy as np
from pyspark.sql import functions as F

from portcullis.llm import lines


def _set(line, n=lines.SHINGLE):
    return frozenset(line[i : i + n] for i in range(max(1, len(line) - n + 1)))


def _brute(rows, part=80, whole=100):
    """Line dedup on shingles of characters; each row is one line."""
    u = brute.Union()
    sets = {k: _set(t) for k, t in rows}
    for a in sets:
        for b in sets:
            m = len(sets[a] & sets[b])
            if a < b and whole * m >= part * (len(sets[a]) + len(sets[b]) - m):
                u.join(a, b)
    heads = defaultdict(list)
    for k in sets:
        heads[u.find(k)].append(k)
    return {k for v in heads.values() for k in v if k != min(v)}


def _dropped(spark, rows):
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("n_dropped > 0")
    return {r.doc_id for r in got.select("doc_id").collect()}


def test_shingles_are_of_characters():
    texts = ["abcdefg", "\u00e9t\u00e9 \u00e0 l'\u00eele", "\u6f22\u5b57\u304b\u306a\u4ea4\u3058\u308a", "\u6f22\u5b57", "x\U0001f642yz\U0001f643w", "a"]
    hashes, n = lines.shingles([t.encode() for t in texts])
    assert n.tolist() == [max(0, len(t) - 4) for t in texts]
    for t, own in zip(texts, np.split(hashes, np.cumsum(n)[:-1]), strict=True):
        alone = [lines.shingles([t[i : i + 5].encode()])[0].tolist() for i in range(len(t) - 4)]
        assert own.tolist() == sorted(x for h in alone for x in h)


def test_shingles_are_distinct_and_chunks_whole():
    many = [b"aaaaaaaa", b"", b"abcabcabc", b"x" * 400_000, *[f"line {i} of many".encode() for i in range(3000)]]
    assert [x for c in lines.chunks(many) for x in c] == many
    assert lines.shingles(many[:3])[1].tolist() == [1, 0, 3]


def test_line_hash_is_the_engines(spark):
    texts = ["a", "Ünïcode straße", "x" * 1000, "漢字かな"]
    got = [r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("xxhash64(t) h").collect()]
    assert [h % (1 << 64) for h in got] == [lines.line_hash(t.encode()) for t in texts]


def test_lines_of_wide_characters(spark):
    r = random.Random(5)
    rows = []
    for n in (25, 30, 40, 60, 90):
        line = [chr(r.randrange(0x4E00, 0x9000)) for _ in range(n)]
        other = list(line)
        other[n // 2] = "\u3042"
        rows += [(len(rows), "".join(line)), (len(rows) + 1, "".join(other))]
    assert _dropped(spark, rows) == _brute(rows) == {7, 9}


def _found(a, b):
    """Whether two sets of shingle hashes are in a list together after lists without near pairs are let go."""
    counts = np.array([len(a), len(b)])
    keys, row, sketch = lines.postings(np.concatenate([np.sort(a), np.sort(b)]), counts)
    own = np.zeros(len(keys), lines._KEYED)
    own["key"], own["line"], own["bits"], own["n"] = keys, row, sketch[row], counts[row]
    return len(lines.collide(own, 80, 100)[0]) > 0


def test_recall_by_number_of_shingles():
    r = np.random.default_rng(7)
    for common, left, right, trials, most in [
        (1, 0, 0, 50, 0), (4, 1, 0, 400, 0), (9, 1, 0, 400, 0), (16, 2, 2, 400, 0), (18, 1, 1, 400, 0), (20, 3, 2, 400, 0), (24, 6, 0, 400, 0), (24, 0, 0, 50, 0),
        (28, 4, 3, 800, 0.012), (40, 5, 5, 800, 0.012), (45, 2, 3, 800, 0.001), (80, 10, 10, 800, 0.012), (180, 10, 10, 400, 0.001),
    ]:
        missed = 0
        for _ in range(trials):
            x = r.integers(0, 1 << 52, common + left + right, dtype=np.uint64)
            missed += not _found(x[: common + left], np.concatenate([x[:common], x[common + left :]]))
        assert missed <= most * trials, (common, left, right, missed)


def test_split_buckets_lose_nothing(spark):
    r = random.Random(4)
    base = " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(30))
    rows = []
    for _ in range(70):
        own = base.split()
        for _ in range(r.randint(0, 3)):
            own[r.randrange(len(own))] = r.choice(["x", "yy", "zzz"])
        rows.append((len(rows), " ".join(own)))
    gone = _brute(rows)
    made = lines.collide
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("text")
    packed = lines._posted(docs, 1, 80, 100).collect()
    whole = made(_keyed(packed), 80, 100)[0]
    parts_, held = set(), np.zeros(0, lines._KEYED)
    for row in packed:  # every posting on its own: what leads stays, the rest is passed on
        for one in np.array_split(_keyed([row]), 40):
            live, leads, rest = made(np.concatenate([held, one]), 80, 100)
            parts_ |= {(int(k), int(x)) for k, x in zip(live["key"], live["line"], strict=True)}
            held = np.concatenate([live[leads], rest])
    assert {(int(k), int(x)) for k, x in zip(whole["key"], whole["line"], strict=True)} <= parts_
    assert gone and _dropped(spark, rows) == gone


def _keyed(packed):
    raw = np.concatenate([np.frombuffer(r.held, lines._POSTING) for r in packed])
    own = np.empty(len(raw), lines._KEYED)
    own["key"] = raw["hi"].astype(np.uint64) << np.uint64(16) | raw["lo"].astype(np.uint64)
    for name in ("line", "bits", "n"):
        own[name] = raw[name]
    return own


def test_clashing_names_nulls_and_repeats(spark):
    text = "the same line of some length\nanother line that stands alone here"
    rows = [(None, text, 1, "a"), (3, text, 2, "b"), (3, text, 2, "c"), (4, None, 3, "d"), (5, "", 4, "e"), (6, "the same line of some length", 5, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone int, row string")
    docs = docs.select("*", *[F.lit(1).alias(c) for c in ("id", "th", "did", "_drop", "line", "n_lines")])
    got = lines.dedup_lines(docs)
    assert got.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    # null keys come first; rows of equal key and text are treated alike
    assert sorted((r.row, r.text, r.n_lines, r.n_dropped) for r in got.collect()) == [("a", text, 2, 0), ("b", "", 2, 2), ("c", "", 2, 2), ("d", None, 0, 0), ("e", "", 0, 0), ("f", "", 1, 1)]
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_short_lines_against_brute_force(spark):
    r = random.Random(11)
    rows = []
    for i in range(60):
        line = "".join(r.choice("abcdefgh ") for _ in range(r.randint(1, 32))).strip() or "x"
        rows.append((len(rows), line))
        rows.append((len(rows), line + r.choice(["y", "yz", "y."])))
        rows.append((len(rows), r.choice("zw") + line))
    gone = _brute(rows)
    assert len(gone) > 40 and _dropped(spark, rows) == gone
