"""Toxicity by class-conditional Kneser-Ney models.

One model is estimated from toxic and one from ordinary training documents, over the characters of each word with
its boundaries: interpolated Kneser-Ney, that is, token counts at the highest order and below it the number of
different characters that an n-gram follows (tokens where it opens the word, which nothing precedes). The lowest
order is shared by both classes, and a toxic context backs off, with the weight of PRIOR tokens, to the ordinary
probability at the same order, so an expression that neither class has seen often gets nearly the same from both. The log-likelihood ratio of a word is the sum over its characters; a document has the ratio by character
(length-normalised), that of its most suspect word and of its most suspect word by character, and the share of
suspect words. A logistic regression on these four, fitted on training documents that the counts have not seen,
makes a probability of them.

Counts come from every labelled document that may be learnt from: words are counted by class with partial aggregation,
each partition of the words sends its character n-gram counts, and the counts of each n-gram are summed up. N-grams are
told apart by 64 bits of hash, each with its own context and shorter n-gram, so the model grows with the different
n-grams of the labelled documents. It is put together on the driver and broadcast. The logistic regression is fitted on
ratios of a model without the fold of the documents it is fitted on; the scores come from a model of all folds.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = 6
BITS = 64  # of an n-gram's hash
DISCOUNT = 0.75
PRIOR = 4.0
SMALL = 2_000_000  # label rows that may be broadcast: about 50 MB
MAX_FIT = 40_000  # labelled rows for the logistic regression
_WORD = re.compile(r"\w+").findall
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return _WORD(text.lower()) if text else []


def ngram_cells(words: list[str], bits: int = BITS, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each predicted character of the words: the index of its word; by order 1..order the hash of the n-gram,
    and of its context. A word is a boundary, its characters, however many, and a boundary. Where it is too short for
    an order the longer context begins with blanks."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    owner = np.repeat(np.arange(len(words)), lengths)
    grams = np.empty((order, len(owner)), np.int64)
    contexts = np.empty((order, len(owner)), np.int64)
    if not len(owner):
        return owner, grams, contexts
    # all words in one row, order-1 blanks before each; then every shift is a slice
    shift = np.uint64(64 - bits)
    before, after = "\0" * (order - 1) + "\2", "\3"
    row = before + (after + before).join(words) + after
    flat = np.frombuffer(row.encode("utf-32-le"), np.uint32).astype(np.uint64)
    at = np.arange(len(owner)) + (owner + 1) * order
    context = np.zeros(len(at), np.uint64)
    for n in range(1, order + 1):
        if n > 1:
            context = (context ^ (flat[at - (n - 1)] + np.uint64(n * 1_000_003))) * _MIX
            context ^= context >> np.uint64(29)
        contexts[n - 1] = (((context + np.uint64(n)) * _MIX) >> shift).view(np.int64)
        grams[n - 1] = ((((context ^ (flat[at] * np.uint64(0xC2B2AE3D27D4EB4F))) + np.uint64(n)) * _MIX) >> shift).view(np.int64)
    return owner, grams, contexts


@dataclass
class Table:
    """Values by sorted key; each column has one value more, for keys that are not there."""

    keys: np.ndarray
    columns: tuple[np.ndarray, ...]

    def __post_init__(self):
        # where the keys of each value of the leading bits begin, some one key each
        self.shift = 64 - max(1, len(self.keys).bit_length())
        high = (self.keys >> self.shift) + (1 << 63 - self.shift)
        self.starts = np.searchsorted(high, np.arange((1 << 64 - self.shift) + 1)).astype(np.int32)

    def places(self, x: np.ndarray) -> np.ndarray:
        """Where the keys x are; the number of keys for one that isn't there."""
        high = (x >> self.shift) + (1 << 63 - self.shift)
        at, end = self.starts[high], self.starts[high + 1]
        todo = np.flatnonzero(at < end)
        while len(todo):
            todo = todo[self.keys[at[todo]] != x[todo]]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        n = len(self.keys)
        if n:
            at[self.keys[np.minimum(at, n - 1)] != x] = n
        return at

    def find(self, x: np.ndarray) -> list[np.ndarray]:
        at = self.places(x)
        return [c[at] for c in self.columns]


@dataclass
class KneserNey:
    """Interpolation tables by order - 1, from the second on: p(character | context) is seen[gram] + back[context] *
    the probability of the next lower order, and for the toxic class + prior[context] * the ordinary probability of
    the same order. seen: ordinary, toxic; rest: back of the ordinary and of the toxic class, prior. base: the shared
    probability by unigram."""

    seen: list[Table]
    rest: list[Table]
    base: Table
    bits: int
    order: int

    def ratio(self, words: list[str]) -> np.ndarray:
        """log p(word | toxic) - log p(word | ordinary)."""
        owner, grams, contexts = ngram_cells(words, self.bits, self.order)
        if not len(owner):
            return np.zeros(len(words))
        ordinary = toxic = self.base.find(grams[0])[0].astype(np.float64)
        live = np.arange(len(owner))  # places whose context is known; a longer one of any other place isn't, either
        for n in range(1, self.order):
            table, rest = self.seen[n - 1], self.rest[n - 1]
            at = rest.places(contexts[n, live])
            known = at < len(rest.keys)
            live, at = live[known], at[known]
            back, its_back, prior = (c[at] for c in rest.columns)
            mine, its = table.find(grams[n, live])
            mine = mine + back * ordinary[live]
            its = its + its_back * toxic[live] + prior * mine
            none = [c[-1] for c in rest.columns]
            ordinary = none[0] * ordinary
            toxic = none[1] * toxic + none[2] * ordinary
            ordinary[live], toxic[live] = mine, its
        return np.bincount(owner, np.log(np.maximum(toxic, 1e-12)) - np.log(np.maximum(ordinary, 1e-12)), len(words))


def count_cells(words: list[str], counts: np.ndarray, bits: int = BITS, order: int = ORDER) -> list[tuple[int, tuple[np.ndarray, ...]]]:
    """Sums over words with counts (n, classes): order - 1, and for each n-gram its hash, tokens (n, classes), hash of
    its context, hash of the n-gram one shorter, and whether it reaches beyond the word's beginning."""
    owner, grams, contexts = ngram_cells(words, bits, order)
    begin = np.arange(1, len(owner) + 1) - np.searchsorted(owner, np.arange(len(words)))[owner] if words else np.zeros(0, int)
    out = []
    for n in range(order):
        by = np.argsort(grams[n])
        cell = grams[n][by]
        starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, int)
        first = by[starts]
        tokens = np.add.reduceat(counts[owner[by]], starts) if len(cell) else np.zeros((0, counts.shape[1]))
        out.append((n, (cell[starts], tokens, contexts[n][first], grams[n - 1][first] if n else np.zeros(len(first), np.int64), begin[first] < n)))
    return out


def build_model(cells: list[tuple[int, tuple[np.ndarray, ...]]], bits: int = BITS, order: int = ORDER, prior: float = PRIOR) -> KneserNey:
    """The tables from sums, tokens by ordinary and toxic, in which no n-gram of an order comes twice."""
    by: dict[tuple[int, int], list[np.ndarray]] = {}
    for n in range(order):
        parts = [p for m, p in cells if m == n] or [(np.zeros(0, np.int64), np.zeros((0, 2)), *[np.zeros(0, np.int64)] * 2, np.zeros(0, bool))]
        cell, tokens, *rest = (np.concatenate(x) for x in zip(*parts))
        for c in (0, 1):
            own = tokens[:, c] > 0
            by[c, n] = [x[own] for x in (cell, tokens[:, c], *rest)]
    of = lambda c, n: by[c, n]
    keys = [np.unique(np.concatenate([of(c, n)[0] for c in (0, 1)])) for n in range(order)]
    at = {(c, n): np.searchsorted(keys[n], of(c, n)[0]) for c in (0, 1) for n in range(order)}
    counts = [[np.zeros(len(k)) for k in keys] for _ in range(2)]
    for c in (0, 1):
        for n in range(order):
            _, tokens, _, shorter, opens = of(c, n)
            if n == order - 1:
                counts[c][n][at[c, n]] = tokens
            if n:
                counts[c][n - 1] += np.bincount(np.searchsorted(keys[n - 1], shorter), np.where(opens, tokens, 1), len(keys[n - 1]))
    shared = np.append(counts[0][0] + counts[1][0], 0) + 0.5
    seen, rests = [], []
    for n in range(1, order):
        contexts = np.unique(np.concatenate([of(c, n)[2] for c in (0, 1)]))
        pair, rest = [], []
        for c in (0, 1):
            own = counts[c][n][at[c, n]]
            context = np.searchsorted(contexts, of(c, n)[2])
            size = len(contexts) + 1  # the last is a context never seen
            total = np.bincount(context, own, size)
            left = np.where(total > 0, DISCOUNT * np.minimum(np.bincount(context, minlength=size), total), 1.0)
            total = np.maximum(total, 1.0) + c * prior
            mine = np.zeros(len(keys[n]) + 1, np.float32)
            mine[at[c, n]] = np.maximum(own - DISCOUNT, 0) / total[context]
            pair.append(mine)
            rest.append((left / total).astype(np.float32))
        seen.append(Table(keys[n], tuple(pair)))
        rests.append(Table(contexts, (*rest, (prior / total).astype(np.float32))))
    return KneserNey(seen, rests, Table(keys[0], ((shared / shared.sum()).astype(np.float32),)), bits, order)


def document_features(ratios: np.ndarray, lengths: np.ndarray) -> tuple[float, float, float, float]:
    """By character, at most of a word, at most of a word by character, share of suspect words. The first and the last
    are damped for short documents, where a single odd word would decide."""
    if not len(ratios):
        return (0.0, 0.0, 0.0, 0.0)
    return (float(ratios.sum() / (lengths.sum() + 300)), float(ratios.max()), float((ratios / lengths).max()), float((ratios > 4).sum() / (len(ratios) + 20)))


class _Numbers(dict):
    """word -> its number; a word that is asked for the first time gets the next one."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Scorer:
    """Features of texts; the ratio of a word is kept, up to ``size`` words."""

    def __init__(self, model: KneserNey, size: int = 200_000):
        self.model, self.size = model, size
        self._forget()

    def _forget(self) -> None:
        self.numbers = _Numbers()
        self.ratios = np.zeros(0)  # by number
        self.lengths = np.zeros(0)

    def features(self, texts: list[str | None]) -> np.ndarray:
        out, at = np.zeros((len(texts), 4)), 0
        while at < len(texts):  # the words of some 2 million characters at once
            end, chars = at, 0
            while end < len(texts) and chars < 2_000_000:
                chars += len(texts[end] or "")
                end += 1
            self._fill(texts[at:end], out[at:end])
            at = end
        return out

    def _fill(self, texts: list[str | None], out: np.ndarray) -> None:
        if len(self.numbers) > self.size:
            self._forget()
        ids = [np.fromiter(map(self.numbers.__getitem__, ws), np.int64, len(ws)) for ws in map(words_of, texts)]
        new = list(islice(self.numbers, len(self.ratios), None))
        parts = [new[i : i + 20_000] for i in range(0, len(new), 20_000)]
        self.ratios = np.concatenate([self.ratios, *map(self.model.ratio, parts)])
        self.lengths = np.concatenate([self.lengths, np.fromiter(map(len, new), np.float64, len(new)) + 1])
        for i, own in enumerate(ids):
            out[i] = document_features(self.ratios[own], self.lengths[own])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights (the last is the intercept) by Newton's method; with one class, or no rows, a constant."""
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        return np.zeros(x.shape[1]), np.ones(x.shape[1]), np.array([0.0] * x.shape[1] + [np.log(p / (1 - p))])
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    reg = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w = w + np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + reg, z.T @ (y - p) - reg @ w)
    return mean, scale, w


def is_held_out():
    """The rows whose labels are never learnt from: crc32 of doc_id as text, modulo 5, is 0. A null id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, label, fold of training rows. A doc_id labelled more than once takes its highest label."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~is_held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("label"))
    # the join is by broadcast as long as the labels are few; beyond that it shuffles
    known = F.broadcast(known) if labels.count() <= SMALL else known
    return docs.select("doc_id", "text").join(known, "doc_id").select(
        "doc_id", "text", (F.col("label") > 0).cast("int").alias("label"), (F.crc32(F.col("doc_id").cast("string")) % 5 == 4).alias("calibrates")
    )


def train_models(rows: DataFrame, bits: int = BITS, order: int = ORDER) -> tuple[KneserNey, KneserNey]:
    """From rows(text, label, calibrates): a model of those that don't calibrate, and one of all."""

    kinds = ["ordinary", "toxic", "ordinary_calibrates", "toxic_calibrates"]
    columns = ["slot", "cell", *kinds, "context", "shorter", "opens"]

    def count(batches):
        import pyarrow as pa

        sums: dict[str, list[int]] = {}

        def flush():
            names = list(sums)
            counts = np.array(list(sums.values()), np.int64).reshape(-1, 4)
            for n, (cell, tokens, *rest) in count_cells(names, counts, bits, order):
                slot = np.full(len(cell), n, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (slot, cell, *np.ascontiguousarray(tokens.T, np.int64), *rest)], names=columns)

        for batch in batches:
            for text, label, calibrates in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for w in words_of(text):
                    if (s := sums.get(w)) is None:
                        s = sums[w] = [0, 0, 0, 0]
                    s[label + 2 * calibrates] += 1
            if len(sums) > 100_000:
                yield from flush()
                sums.clear()
        yield from flush()

    schema = ", ".join(["slot int", *(f"{c} bigint" for c in columns[1:-1]), "opens boolean"])
    sent = rows.select("text", "label", "calibrates").mapInArrow(count, schema)
    table = sent.groupBy("slot", "cell").agg(*(F.sum(c).alias(c) for c in kinds), *(F.max(c).alias(c) for c in columns[6:]))
    types = (np.int32, *[np.int64] * 7, np.bool_)

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(i).to_numpy(zero_copy_only=False).astype(t).tobytes()]) for i, t in enumerate(types)], names=columns)

    some, every = [], []
    for r in table.mapInArrow(pack, ", ".join(f"{c} binary" for c in columns)).toLocalIterator():
        slot, cell, a, b, c, d, *rest = (np.frombuffer(x, t) for x, t in zip(r, types))
        for n in range(order):
            own = slot == n
            for out, tokens in ((some, (a, b)), (every, (a + c, b + d))):
                out.append((n, (cell[own], np.column_stack(tokens)[own], *(x[own] for x in rest))))
    return build_model(some, bits, order), build_model(every, bits, order)


def classify(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs(doc_id, text), by labels(doc_id, toxic).

    A null or empty text has no words and the score of a document without suspect words; repeated rows score alike;
    an empty table gives none; without labels of both classes the score is constant. Other columns are not read."""
    spark = docs.sparkSession
    rows = _labelled(docs, labels)
    shared = [spark.sparkContext.broadcast(m) for m in train_models(rows)]
    scorers: dict[int, Scorer] = {}

    def scorer(k: int) -> Scorer:
        if k not in scorers:
            scorers[k] = Scorer(shared[k].value)
        return scorers[k]

    def features(batches):
        import pyarrow as pa

        for batch in batches:
            x = scorer(0).features(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, i]) for i in range(4)), batch.column(1)], names=["a", "b", "c", "d", "label"])

    sample = rows.where("calibrates").select("doc_id", "text", "label")
    sample = sample.join(F.broadcast(sample.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit)), "doc_id", "left_semi")
    got = sample.select("text", "label").mapInArrow(features, "a double, b double, c double, d double, label int").toPandas()
    got = got.sort_values(list(got.columns))
    mean, scale, w = fit_logistic(got[["a", "b", "c", "d"]].to_numpy(np.float64), got["label"].to_numpy(np.float64))

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            x = (scorer(1).features(batch.column(1).to_pylist()) - mean) / scale
            p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(score, "doc_id bigint, score double")
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
