"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is binned; cyclic boosting visits the features in turn, fits a shallow tree to the gradients
summed by bin, and adds a little of it to that feature's lookup table. The pairs whose residuals gain most from a
two-way cut are then boosted in the same way into two-way tables. A score is the logistic of a sum of table entries,
so it is added up for whole batches, and each table can be read as the effect of its feature.

Training rows are at most ``max_rows`` labelled rows, the first by a hash of doc_id; all texts are scored, whole.
"""

from __future__ import annotations

import string
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclens.llm.store import give_back

SLICE = 512  # rows that are kept or rejected at once
MAX_ROWS = 40_000
FEATURES = (
    "log_chars", "word_length", "symbols", "upper", "digits", "exclaim", "bars", "distinct_words", "top_word", "repeated_lines",
    "line_length", "stops", "short_words", "long_words", "blanks", "wide", "brackets", "closed_lines", "words_per_line",
)
_UPPER, _DIGITS = string.ascii_uppercase.encode(), string.digits.encode()
_SYMBOLS = b"#$%&*+/<=>@\\^_`{}~"
_KEEP_UPPER = bytes(set(range(256)) - set(_UPPER))
_KEEP_DIGITS = bytes(set(range(256)) - set(_DIGITS))
_KEEP_SYMBOLS = bytes(set(range(256)) - set(_SYMBOLS))
_KEEP_WIDE = bytes(range(128))


def features(text: str | None) -> tuple[float, ...]:
    """The features of a whole text; a null one counts as empty, and all its features are 0."""
    if not text:
        return (0.0,) * len(FEATURES)
    data = text.encode()
    n = len(data)
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    k, m = max(1, len(words)), max(1, len(lines))
    lengths = np.fromiter(map(len, words), np.int32, len(words))
    counts = Counter(words)
    share = lambda keep: len(data.translate(None, keep)) / n
    return (
        float(np.log1p(n)),
        float(lengths.sum()) / k,
        share(_KEEP_SYMBOLS),
        share(_KEEP_UPPER),
        share(_KEEP_DIGITS),
        text.count("!") / k,
        text.count("|") / k,
        len(counts) / k**0.8,
        max(counts.values(), default=0) / k,
        1 - len(set(lines)) / m,
        float(np.log1p(n / m)),
        text.count(". ") / k + text.count(".\n") / k,
        float((lengths <= 3).sum()) / k,
        float((lengths >= 12).sum()) / k,
        (n - int(lengths.sum())) / n,
        share(_KEEP_WIDE),
        (text.count("(") + text.count("[") + text.count("http")) / k,
        sum([x.endswith((".", "!", "?", '"', ":")) for x in lines]) / m,
        float(np.log1p(k / m)),
    )


@dataclass
class Gam:
    """Lookup tables. edges[f]: the bins' inner edges; tables[f]: a value a bin; pairs: (f, g) -> two-way table over
    coarser bins, coarse[f] of each bin."""

    bias: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros(x.shape, np.int64)

    def logits(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.bias)
        for f, t in enumerate(self.tables):
            out += t[b[:, f]]
        for (f, g), t in self.pairs.items():
            out += t[self.coarse[f][b[:, f]], self.coarse[g][b[:, g]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _tree(grad: np.ndarray, hess: np.ndarray, depth: int, ridge: float, least: float) -> np.ndarray:
    """Newton values of a tree of that depth over ordered bins; a split needs ``least`` hessian on either side."""
    if depth and len(grad) > 1:
        g, h = np.cumsum(grad)[:-1], np.cumsum(hess)[:-1]
        rest_g, rest_h = grad.sum() - g, hess.sum() - h
        gain = np.where((h >= least) & (rest_h >= least), g * g / (h + ridge) + rest_g * rest_g / (rest_h + ridge), -1.0)
        at = int(gain.argmax()) + 1
        if gain[at - 1] > grad.sum() ** 2 / (hess.sum() + ridge) + 1e-9:
            return np.concatenate([_tree(grad[:at], hess[:at], depth - 1, ridge, least), _tree(grad[at:], hess[at:], depth - 1, ridge, least)])
    return np.full(len(grad), grad.sum() / (hess.sum() + ridge))


def _cross(grad: np.ndarray, hess: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best two-way cut of a grid, four leaves: its gain and its values."""
    g, h = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    parts = lambda a: (a[:-1, :-1], a[:-1, -1:] - a[:-1, :-1], a[-1:, :-1] - a[:-1, :-1], a[-1, -1] - a[:-1, -1:] - a[-1:, :-1] + a[:-1, :-1])
    gs, hs = parts(g), parts(h)
    gain = sum(a * a / (b + ridge) for a, b in zip(gs, hs))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    value = [float(a[i, j] / (b[i, j] + ridge)) for a, b in zip(gs, hs)]
    out = np.empty(grad.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = value
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, grid: int = 8, rounds: int = 120, pair_rounds: int = 60, n_pairs: int = 6, rate: float = 0.15, ridge: float = 2.0, least: float = 4.0) -> Gam:
    """Tables from features and labels (0, 1). With no rows, or rows of one class, the score is constant: the share
    of label 1, smoothed by half a row of each."""
    p = (y.sum() + 0.5) / (len(y) + 1.0)
    quantiles = np.linspace(0, 1, bins + 1)[1:-1]
    edges = [np.unique(np.quantile(x[:, f], quantiles)) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    coarse = [np.minimum(np.arange(len(e) + 1) * grid // (len(e) + 1), grid - 1) for e in edges]
    model = Gam(float(np.log(p / (1 - p))), edges, [np.zeros(len(e) + 1) for e in edges], coarse)
    if len(y) == 0 or y.min() == y.max():
        return model
    b = model.bins(x)
    logit = np.full(len(y), model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-logit))
        return y - q, np.maximum(q * (1 - q), 1e-6)

    for _ in range(rounds):
        for f, table in enumerate(model.tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(b[:, f], g, len(table)), np.bincount(b[:, f], h, len(table)), 2, ridge, least)
            table += step
            logit += step[b[:, f]]
    c = [coarse[f][b[:, f]] for f in range(x.shape[1])]
    cell = lambda f, g, w: np.bincount(c[f] * grid + c[g], w, grid * grid).reshape(grid, grid)
    g, h = slopes()
    ranked = sorted(((_cross(cell(i, j, g), cell(i, j, h), ridge)[0], i, j) for i in range(len(edges)) for j in range(i)), reverse=True)
    model.pairs = {(i, j): np.zeros((grid, grid)) for _, i, j in ranked[:n_pairs]}
    for _ in range(pair_rounds):
        for (i, j), table in model.pairs.items():
            g, h = slopes()
            step = rate * _cross(cell(i, j, g), cell(i, j, h), ridge)[1]
            table += step
            logit += step[c[i], c[j]]
    return model


def is_held_out():
    """The rows whose labels are never learnt from: crc32 of doc_id as text, modulo 3, is 1. A null id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Gam:
    """Fit on docs(doc_id, text) with labels(doc_id, quality). A doc_id labelled more than once takes its lowest
    label; null labels and ids are left out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~is_held_out())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # at most max_rows rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", F.col("label").cast("int").alias("label"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.array([features(t) for t in batch.column(0).to_pylist()], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], names=["x", "label"])

    got = rows.mapInArrow(run, "x array<double>, label int").toPandas()
    x = np.array(list(got["x"]), np.float64).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, got["label"].to_numpy())) if len(x) else np.zeros(0, int)  # the same sums whatever order the rows arrive in
    return fit(x[order], (got["label"].to_numpy()[order] > 0).astype(float))


def score_documents(docs: DataFrame, model: Gam) -> DataFrame:
    """doc_id and score, 0 to 1, for every row of docs(doc_id, text); a null text is scored as an empty one."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.array([features(t) for t in batch.column(1).to_pylist()], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")


def keep_good(docs: DataFrame, model: Gam, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores threshold or more, with all their columns."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            for i in range(0, len(texts), SLICE):  # so that few texts are there as Python strings
                x = np.array([features(t.as_py()) for t in texts.slice(i, SLICE)], np.float64).reshape(-1, len(FEATURES))
                yield batch.slice(i, SLICE).filter(pa.array(model.score(x) >= threshold))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs. Repeated rows are scored alike, an empty table gives
    none, other columns are not read."""
    scored = score_documents(docs, train(docs, labels, max_rows))
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
