"""Line dedup: what is made once a line, and that the shorter ways to the same links are exact."""

import random

import pytest
from pyspark.sql import functions as F

from doclens.llm import line_dedup

from .test_advice_lines import kept_lines


def sets(line):
    return frozenset(line[i : i + 8] for i in range(max(1, len(line) - 7)))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_split_once(frame):
    assert plan(line_dedup._lines(frame(["a\nb"]))).count("split(") == 1


def test_signatures_take_no_row_for_a_shingle(frame):
    texts = frame(["one line"]).select(F.col("doc_id").alias("key"), F.col("text").alias("norm"))
    made = plan(line_dedup._buckets(line_dedup._bins(texts), (1, 0)))
    assert "Generate" not in made and "Aggregate" not in made


def lines(rng):
    """Lines of few and many words with a few changes; some of one word, without blanks, periodic, or beyond ASCII."""
    out = []
    for alphabet in ("abcdef", "aé😀ñ", "ab"):
        for n in (1, 2, 8, 30, 60):
            words = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 12))) for _ in range(n)]
            for edits in (0, 1, 2, 4):
                changed = list(words)
                for _ in range(edits):
                    i = rng.randrange(len(changed) or 1)
                    changed[i : i + 1] = rng.choice([[], ["other"], [*changed[i : i + 1] * 2], [*changed[i : i + 1], ""]])
                out.append(" ".join(changed) or "x")
    return [*out, "=" * 30, "=" * 50, "der " * 9 + "d", "der " * 20, "a" * 7, "a" * 8, " ".join("a" * 40), "x" * 300, "x" * 299 + "y", "two parts of a line", "two parts of a line"]


@pytest.mark.parametrize("few", [0, 3, 256])
def test_pairs_are_judged_exactly(spark, monkeypatch, few):
    monkeypatch.setattr(line_dedup, "FEW", few)
    texts = sorted(set(lines(random.Random(few + 5))))
    every = [(a, b, len(sets(texts[a])), len(sets(texts[b]))) for a in range(len(texts)) for b in range(a + 1, len(texts))]
    similar = lambda a, b: len(a & b) >= 0.8 * len(a | b) - 1e-9
    want = {(a, b) for a, b, *_ in every if similar(sets(texts[a]), sets(texts[b]))}
    pairs = spark.createDataFrame(every, "a bigint, b bigint, a_n bigint, b_n bigint")
    rows = spark.createDataFrame(list(enumerate(texts)), "key bigint, norm string")
    assert {(r.a, r.b) for r in line_dedup.verified_pairs(rows, pairs).collect()} == want
    assert len(want) > 20


def test_lines_too_long_for_an_array(frame, spark, monkeypatch):
    letters = "".join(random.Random(3).choice("abcdefgh") for _ in range(400))
    texts = [letters, letters[:200] + "#" + letters[200:], letters[::-1], "ab " * 90, "ab " * 120, "short line", "short line"]
    rows = spark.createDataFrame(list(enumerate(texts[:6])), "key bigint, norm string")
    bands = lambda: {(r.key, b) for r in line_dedup.signatures(rows).collect() for b in r.buckets}
    whole = bands()
    for most in (0, 150):
        monkeypatch.setattr(line_dedup, "ARRAY", most)
        assert bands() == whole
        assert {r.doc_id for r in line_dedup.dedup_lines(frame(texts)).collect() if r.n_kept_lines} == kept_lines(texts)
