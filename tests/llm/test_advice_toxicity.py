"""Toxicity: no n-gram shares counts with another, and no learnable document is left out."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from doclens.llm import toxicity_kn

from .conftest import words


def test_model_grows_with_the_ngrams():
    rng = random.Random(1)
    ws = sorted({"".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöü") for _ in range(12)) for _ in range(90_000)})
    grams = toxicity_kn.ngram_cells(ws)[1]
    for n in range(6):
        different = {("\2" + w + "\3")[max(0, k - n) : k + 1].rjust(n + 1, "\0") for w in ws for k in range(1, len(w) + 2)}
        assert len(np.unique(grams[n])) == len(different)


def test_every_learnable_fold_counts(spark, frame):
    rng = random.Random(4)
    rows = spark.range(600).select("id", (F.crc32(F.col("id").cast("string")) % 5).alias("fold")).collect()
    texts, marks = [], []
    for r in rows:
        w, toxic = words(rng, 40), r.id % 4 == 0
        if toxic:
            w[3] = w[11] = w[30] = "qozzik" if r.fold in (0, 4) and r.id % 8 == 0 else "vilkar"
        texts.append(" ".join(w))
        marks.append((r.id, int(toxic)))
    labels = spark.createDataFrame(marks, "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity_kn.classify(frame(texts), labels).collect()}
    held = [got[r.id] for r in rows if r.fold == 0 and r.id % 8 == 0]
    assert len(held) > 8 and all(r.held_out and r.predicted == 1 for r in held)


class Plain:
    """The same model by definition, over strings; a list of counts by class for each word."""

    def __init__(self, words, counts, order, discount=toxicity_kn.DISCOUNT, prior=toxicity_kn.PRIOR):
        self.order, self.discount, self.prior = order, discount, prior
        self.counts = [[Counter() for _ in range(order)] for _ in range(2)]
        for c in (0, 1):
            for word, n in zip(words, counts):
                for gram in self.grams(word, order):
                    self.counts[c][order - 1][gram] += int(n[c])
            for k in range(order - 1, 0, -1):
                tokens = Counter()
                for word, n in zip(words, counts):
                    for gram in self.grams(word, k + 1):
                        tokens[gram] += int(n[c])
                for gram, n in tokens.items():
                    self.counts[c][k - 1][gram[1:]] += (n if gram[0] == "\0" else 1) * (n > 0)
        for each in self.counts:
            for k, counter in enumerate(each):
                each[k] = +counter
        self.known = set(self.counts[0][0]) | set(self.counts[1][0])

    def grams(self, word, n):
        row = "\0" * (self.order - 1) + "\2" + word + "\3"
        return [row[k - n + 1 : k + 1] for k in range(self.order, len(row))]

    def p(self, c, gram):
        """Of the last character after the others."""
        if len(gram) == 1:
            both = lambda g: self.counts[0][0][g] + self.counts[1][0][g] + 0.5
            return both(gram) / (sum(map(both, self.known)) + 0.5)
        counts = self.counts[c][len(gram) - 1]
        after = [n for g, n in counts.items() if g[:-1] == gram[:-1]]
        total = max(sum(after), 1) + c * self.prior
        rest = self.discount * len(after) if after else 1.0
        shared = self.prior * self.p(0, gram) if c else 0.0
        return (max(counts[gram] - self.discount, 0) + rest * self.p(c, gram[1:]) + shared) / total

    def ratio(self, word):
        return sum(math.log(self.p(1, g) / self.p(0, g)) for g in self.grams(word, self.order))


def test_model_is_kneser_ney():
    rng = random.Random(3)
    ws = sorted({"".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7))) for _ in range(60)})
    counts = np.array([[rng.randrange(6), rng.choice((0, 0, 1, 3))] for _ in ws])
    for order in (2, 4, 6):
        plain = Plain(ws, counts, order)
        model = toxicity_kn.build_model(toxicity_kn.count_cells(ws, counts, order=order), order=order)
        asked = [*ws, "zz", "abz", "", "edcbaedcba"]
        assert np.allclose(model.ratio(asked), [plain.ratio(w) for w in asked], atol=1e-4)
        for context in ("\0\0\0\0\0\2"[-(order - 1) :], "cabacab"[: order - 1], "zzzzzzz"[: order - 1]):
            for c in (0, 1):
                assert abs(sum(plain.p(c, context + x) for x in [*plain.known, "?"]) - 1) < 1e-9


def test_scorer_forgets_and_takes_texts_in_parts():
    rng = random.Random(9)
    ws = words(rng, 400)
    model = toxicity_kn.build_model(toxicity_kn.count_cells(ws, np.array([[1, k % 3] for k in range(len(ws))])))
    texts = [" ".join(words(rng, 50)) for _ in range(30)] + [None, "", "..."]
    whole = toxicity_kn.Scorer(model).features(texts)
    forgetful = toxicity_kn.Scorer(model, size=20)
    assert np.array_equal(whole, np.vstack([forgetful.features([t]) for t in texts]))
    assert not whole[-3:].any()
