import pytest


@pytest.fixture(scope="session")
def llm(spark):
    from vigil.llm.common import ready
    ready(spark)
    return spark


@pytest.fixture(scope="session")
def docs_of(llm):
    """Documents from (doc_id, text, source) rows, with columns whose names clash with those used inside."""
    def make(rows):
        rows = [(*r, "src0")[:3] for r in rows]
        return llm.createDataFrame([(k, t, s, 1, 2, "x") for k, t, s in rows], "doc_id long, text string, source string, sid long, n int, word string")
    return make


WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "nu", "pe") for b in ("ra", "so", "ti", "vu") for c in ("n", "sh", "m", "")]


@pytest.fixture(scope="session")
def prose():
    """Seeded invented prose."""
    import random

    def make(n, seed):
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))
    return make
