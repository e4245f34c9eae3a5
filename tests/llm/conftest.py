import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def _word(r):
    return "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 5)))


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, shared passages and lines, and odd texts."""
    r = random.Random(3)
    text = lambda n: " ".join(_word(r) for _ in range(n))
    passage, line = text(60), "Shared line of some length, number one."
    out = []
    base = text(150).split()
    for i in range(60):
        kind = i % 6
        if kind == 0:
            own = list(base)
            for _ in range(r.randint(0, 14)):
                own[r.randrange(len(own))] = _word(r)
            t = " ".join(own)
        elif kind == 1:
            t = text(30) + " " + passage + " " + text(20)
        elif kind == 2:
            t = f"{text(12)}\n{line}\n\n{text(9)}\n{line[:-2]}!"
        elif kind == 3:
            t = " ".join(base)
        elif kind == 4:
            t = text(r.randint(1, 5))
        else:
            t = text(200).title()
        out.append((i, t))
    odd = [None, "", "   \n\t ", "a", "a b", "the " * 300, "Ünïcode straße 漢字 🙂 don't <|endoftext|> it's", "x" * 5000, "A B C " * 40, "12 34 !! ??", " nbsp em \x1c fs", "word\r\nline\rmore"]
    out += [(100 + i, t) for i, t in enumerate(odd)]
    out += [(200, text(40_000))]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The same with extra columns whose names clash with the operators' own."""
    data = [(k, t, "en" if k % 2 else "fr", "s", 1, True, 2.0) for k, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_words long, kept boolean, score double").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
