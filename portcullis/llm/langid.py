"""Language identification by a string kernel.

Kernel: the blended spectrum of byte 1-, 2- and 3-grams, presence only, normalised:
k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|), with G hashed to a fixed number of features. Nystroem landmarks
give phi(x) = k(x, landmarks) K^(-1/2), and one ridge regression a language (one against the rest) is solved on
phi. As k is linear in the normalised presence vectors, landmarks and weights fold into one matrix, and a batch is
scored by one matrix product. The fit takes a bounded sample of labelled rows (``per_language`` rows at most for
each language, those of least hash of id and text); only their feature bits reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import blocks as B

PER_LANGUAGE, LANDMARKS, RIDGE, SHARPNESS = 500, 400, 1e-2, 6.0
UNKNOWN = "und"
_TWO, _THREE = 12, 13
FEATURES = 256 + (1 << _TWO) + (1 << _THREE)
_ROWS = 256  # rows to a matrix product
_PART = 1 << 20

#: ASCII letters folded to lower case, other ASCII to a space.
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)
_K1, _K2, _MIX = np.uint32(0x01000193), np.uint32(0x00010DCD), np.uint32(0x9E3779B1)


def presence(data: np.ndarray) -> np.ndarray:
    """Boolean features of one text: which hashed 1-, 2- and 3-grams occur in the whole of it."""
    out = np.zeros(FEATURES, bool)
    for lo in range(0, len(data), _PART):
        x = _FOLD[data[lo : lo + _PART + 2]]
        out[x] = True
        wide = x.astype(np.uint32)
        pair = wide[:-1] * _K1 + wide[1:]
        out[256 + (pair * _MIX >> np.uint32(32 - _TWO))] = True
        three = pair[:-1] * _K2 + wide[2:]
        out[256 + (1 << _TWO) + (three * _MIX >> np.uint32(32 - _THREE))] = True
    out[32] = False  # a space says nothing
    return out


def _matrices(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    for block in B.blocks(column):
        for lo in range(0, block.rows, _ROWS):
            edge = block.offsets[lo : lo + _ROWS + 1]
            yield block.first + lo, np.stack([presence(block.data[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)])


def _normal(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float32)
    return x / np.sqrt(np.maximum(1, x.sum(1)))[:, None]


def solve(x: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> tuple[list[str], np.ndarray]:
    """Languages and the folded matrix (features + 1, languages; the last row is the offset)."""
    names = sorted(set(labels))
    y = np.where(np.array(labels)[:, None] == np.array(names), 1.0, -1.0)
    # evenly from each language, as far as they go
    turns = {n: [i for i, lab in enumerate(labels) if lab == n] for n in names}
    chosen = [turns[n][k] for k in range(max(map(len, turns.values()))) for n in names if k < len(turns[n])][:landmarks]
    marks = _normal(x[chosen]).astype(np.float64)
    values, vectors = np.linalg.eigh(marks @ marks.T)
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])  # K^(-1/2) up to a rotation
    phi = np.concatenate([_normal(x[lo : lo + _ROWS]) @ marks.T @ root for lo in range(0, len(x), _ROWS)])  # a few rows at a time, for memory
    weight = 1 / np.sqrt([[labels.count(lab)] for lab in labels])  # languages count alike
    phi1 = np.hstack([phi, np.ones((len(phi), 1))])
    a = (phi1 * weight**2).T @ phi1 + ridge * np.diag([1.0] * phi.shape[1] + [0.0]) + 1e-9 * np.eye(phi1.shape[1])
    w = np.linalg.solve(a, (phi1 * weight**2).T @ y)
    return names, np.vstack([marks.T @ (root @ w[:-1]), w[-1:]]).astype(np.float32)


def fit(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray] | None:
    """Learn from the rows where ``train`` holds, whose language is known and whose text has a letter; None without any.

    The sample of a language is the ``per_language`` least hashes of id and text among its rows, so it does not depend on
    how rows are dealt to tasks. Ids may be null or repeat: rows equal in both are one, other rows each have a hash of their
    own. The driver gets the feature bits of the sample, ``per_language`` a language at most.
    """
    hashed = F.xxhash64(F.col(f"`{key}`").cast("string"), F.col(f"`{text}`"), F.lit(9))
    rows = docs.where(train & F.col(f"`{lang}`").isNotNull() & has_letter(text)).select(F.col(f"`{text}`").alias("_text"), F.col(f"`{lang}`").cast("string").alias("_lang"), hashed.alias("_h"))
    place = F.row_number().over(Window.partitionBy("_lang").orderBy("_h"))  # Spark keeps the least of each task before it shuffles
    least = rows.select("_lang", "_h").distinct().withColumn("_i", place).where(F.col("_i") <= per_language).select("_lang", "_h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, x in _matrices(batch.column("_text")):
                own = batch.slice(first, len(x))
                yield pa.RecordBatch.from_arrays([own.column("_lang"), own.column("_h"), pa.array([np.packbits(r).tobytes() for r in x], pa.binary())], names=["lang", "h", "bits"])

    some = rows.join(F.broadcast(least), ["_lang", "_h"], "left_semi").select("_text", "_lang", "_h")  # per_language short rows a language
    kept = sorted((r["lang"], r["h"], r["bits"]) for r in some.mapInArrow(run, "lang string, h long, bits binary").groupBy("lang", "h").agg(F.first("bits").alias("bits")).collect())
    if not kept:
        return None
    x = np.unpackbits(np.stack([np.frombuffer(r[2], np.uint8) for r in kept]), axis=1)[:, :FEATURES]
    return solve(x, [r[0] for r in kept])


def has_letter(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray] | None, text: str = "text") -> DataFrame:
    """docs with lang_pred (``und`` for a null or letterless text, or without a model) and score in 0..1.

    Columns of these two names are replaced; all others are kept.
    """
    others = [c for c in docs.columns if c not in ("lang_pred", "score")]
    place = others.index(text)
    if model is None:
        return docs.select(*[F.col(f"`{c}`") for c in others]).withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("score", F.lit(0.0))
    names, matrix = model
    held = docs.sparkSession.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            scores = np.concatenate([_normal(x) @ weights[:-1] + weights[-1] for _, x in _matrices(batch.column("row").field(place))])
            best = scores.argmax(1)
            odds = np.exp(SHARPNESS * (scores - scores.max(1, keepdims=True)))
            sure = 1 / odds.sum(1)
            known = batch.column("letters").to_numpy(zero_copy_only=False)
            lang = pa.array(np.where(known, np.array(names, object)[best], UNKNOWN), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("row"), lang, pa.array(np.where(known, sure, 0.0), pa.float64())], names=["row", "lang_pred", "score"])

    # the row travels as one value, so its columns may have any names
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"))
    kinds = rows.schema["row"].dataType.simpleString()
    scored = rows.withColumn("letters", has_letter(f"row.`{text}`")).mapInArrow(run, f"row {kinds}, lang_pred string, score double")
    return scored.select(*[F.col(f"row.`{c}`").alias(c) for c in others], "lang_pred", "score")


def held_out(key: str = "doc_id", folds: int = 5) -> Column:
    """Whether crc32 of the id's text is a multiple of ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds == 0
