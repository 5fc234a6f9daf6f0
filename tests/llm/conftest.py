import random

import pytest

WORDS = [a + b for a in "ka lo mi ne pu ra se ti".split() for b in "ban del fir gos hun jat kel mor".split()]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `value` string, rate double, h1 long, doc long, size long, row long, _gone long"


def words(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return [r.choice(WORDS) + r.choice(WORDS) for _ in range(n)]


def make_docs(spark, texts: list, ids=None):
    """Documents with nulls, and columns whose names the operators use themselves."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, None, None if n % 5 == 4 else f"s{n % 3}", None, "v", 1.0, 1, 1, 1, 1, 1) for n, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def texts():
    """Ordinary texts with the awkward cases among them: null, empty, blank, copies, near copies, a very long one."""
    out = [" ".join(words(i, 60 + i)) for i in range(24)]
    near = out[0].split()
    near[30] = "other"
    return [*out, None, "", "  \t\n ", out[1], out[1], " ".join(near), "\n".join([out[2], "a shared line of text", "x"]), "A Shared Line of Text  \nsomething else entirely", " ".join(words(99, 30_000))]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """As texts; then a repeated row and a row without an id."""
    ids = [*range(len(texts)), 3, None]
    return make_docs(spark, [*texts, texts[3], "a row without an id but with a few words"], ids).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
