import random

import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept boolean"


def words(rng, n):
    return [rng.choice("th er on an re he in ed nd ha at en es of or nt ea ti to it st".split()) + rng.choice("ing ly ble tion ou er es".split()) + str(rng.randrange(40)) for _ in range(n)]


@pytest.fixture(scope="session")
def frame(spark):
    def make(texts):
        """documents from texts or (doc_id, text), with columns whose names results also use."""
        rows = [t if isinstance(t, tuple) else (k, t) for k, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", "s", None, 0.5, True) for i, t in rows], DOC)

    return make


@pytest.fixture(scope="session")
def corpus():
    """Texts with exact and near copies, repeated lines, nulls, blanks and one very long text."""
    rng = random.Random(7)
    base = [" ".join(words(rng, rng.randrange(30, 120))) for _ in range(25)]
    out = []
    for k, t in enumerate(base):
        w = t.split()
        lines = "\n".join(" ".join(w[i : i + 12]) for i in range(0, len(w), 12))
        out.append(f"A line that many texts have.\n{lines}")
        if k % 3 == 0:
            out.append(out[-1])
        if k % 4 == 0:
            v = lines.split(" ")
            v[len(v) // 2] = "changed"
            out.append(" ".join(v))
        if k % 5 == 0:
            v = lines.split(" ")
            out.append(" ".join(x if j % 6 else "else" for j, x in enumerate(v)))
    return [*out, None, "", " \n\n ", "one two", "one two", "é", "x" * 50_000, " ".join(words(rng, 3000))]
