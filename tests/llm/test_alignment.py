import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from portcullis.llm import alignment, queries

A, B = queries.vocabulary(), queries.vocabulary("piece_bpe_32k.model")


def brute(rows):
    """The figures of each row, by a plain walk over the tokens of whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in shown}
    for b in range(256):
        if b not in shown:
            byte_of[chr(0x100 + len(byte_of) - len(shown))] = b
    found = []
    for _, text in rows:
        if not text:
            found.append(None)
            continue
        a = [(i, bytes(byte_of[c] for c in one.id_to_token(i))) for i in one.encode(" " + text, add_special_tokens=False).ids]
        pieces = [(i, two.id_to_piece(i)) for i in two.encode(text)]
        b = [(i, bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces]
        if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
            found.append(None)
            continue
        ends = []
        for side in (a, b):
            at, here = 0, []
            for _, x in side:
                at += len(x)
                here.append(at)
            ends.append(here)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, i, j = [], 0, 0
        for c in cuts:
            left, right = [], []
            while i < len(a) and ends[0][i] <= c:
                left.append(a[i][0])
                i += 1
            while j < len(b) and ends[1][j] <= c:
                right.append(b[j][0])
                j += 1
            groups.append((left, right))
        found.append((len(a), len(b), groups, Counter((x, y) for left, right in groups for x in left for y in right)))
    count = Counter(p for f in found if f for p in f[3])
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (key, _), f in zip(rows, found, strict=True):
        if f is None:
            out.append((key, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = f
        said = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in groups)
        out.append((key, n_a, n_b, len(groups), sum(links.values()), sum(m for p, m in links.items() if count[p] == best[p[0]]), sum(m * count[p] for p, m in links.items()), hashlib.sha256(said.encode()).hexdigest()))
    return out


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    "  two  spaces   three ", " ", "\n", "\n\n a\tb \n", "a▁b", "ﬁ ½ Å ǅ ə ʿ", "漢字かな 交じり文", "🙂🙂 👩‍👩‍👧", "<s> </s> <unk> <0x0A> <|endoftext|>", "x" * 3000, "ab" * 500, "don't I'll we've", "\x00\x01\x7f", "é" * 40, "é combining",
    "1234567890 12 3", "a\xa0b　c d", "the " * 70_000,
]


def test_against_brute_force(docs, rows, spark):
    got = alignment.align(docs, A, B)
    assert sorted(map(tuple, got.select("doc_id", *NAMES).collect())) == sorted(brute(rows))


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_odd_texts_in_chunks_of_any_size(spark, size):
    rows = list(enumerate(ODD))
    given = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = alignment.align(given, A, B, chunk_docs=size, chunk_postings=5)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows))


def test_multiplicities_beyond_one_entry(spark, monkeypatch):
    monkeypatch.setattr(alignment, "_MOST", 65535)
    parts = [(alignment.np.array([3, 4]), alignment.np.array([9, 9]), alignment.np.array([200_000, 5]))]
    pair, documents, size, entries = alignment._posted(parts)
    assert (pair.tolist(), documents.tolist(), size.tolist()) == ([9], [2], [5])
    assert [(e >> 16, e & 65535) for e in entries.tolist()] == [(3, 65535), (3, 65535), (3, 65535), (3, 200_000 - 3 * 65535), (4, 5)]


def test_null_and_repeated_keys_and_empty_tables(spark, empty):
    assert alignment.align(empty, A, B).count() == 0
    rows = [(None, "a cat"), (None, "a cat"), (1, "a cat"), (1, "dog"), (2, None), (3, "")]
    got = alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), A, B)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute(rows)))
    none = spark.createDataFrame([(2, None, 1), (3, "", 2)], "doc_id long, text string, chunk long")
    assert [r.n_links for r in alignment.align(none, A, B).collect()] == [0, 0]


def test_query_against_brute_force(spark, sf_dir):
    got = queries.op13_alignment(spark, sf_dir)
    assert dict(got.dtypes) == {"doc_id": "bigint", "groups_sha256": "string"} | dict.fromkeys(NAMES[:-1], "bigint")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text")).collect()]
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows))
