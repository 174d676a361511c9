"""Pairs of vector blocks: nothing is sent to its partners, and what is bounded as a whole is counted as point by point."""

import numpy as np

from doclens.llm import embedding_covertree

from .test_pairs import Union


def shuffled(spark) -> int:
    """Bytes that all stages so far have written to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_vectors_are_not_sent_to_every_partner(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    tight = x[0] + rng.normal(size=(300, 64)) * 0.0125  # one node in most trees
    loose = x[1] + rng.normal(size=(200, 64)) * 0.028  # cosines on both sides of 0.95
    x = np.concatenate([x, tight, loose, x[5:6], x[5:6]]).astype(np.float32)
    x = x[rng.permutation(len(x))]
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    want = Union()
    for i, j in zip(*np.nonzero(link)):
        want.join(int(i), int(j))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    monkeypatch.setattr(embedding_covertree, "BLOCK", 64)
    monkeypatch.setattr(embedding_covertree, "PACKS", 6, raising=False)
    monkeypatch.setattr(embedding_covertree, "PIECE", 24, raising=False)
    before = shuffled(spark)
    rows = embedding_covertree.near_duplicates(df).collect()
    assert shuffled(spark) - before < 4 * x.nbytes
    assert {r.vec_id: (r.n_links, r.component_id) for r in rows} == {k: (link[k].sum(), want.find(k)) for k in range(len(x))}


def test_vectors_of_extreme_lengths_and_many_copies(spark, monkeypatch):
    """Finite components whose squares overflow or vanish; copies beyond what is broadcast."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(200, 40))
    x = np.concatenate([base, base[0] + rng.normal(size=(60, 40)) * 0.15, np.repeat(base[:1], 90, 0), np.repeat(base[50:70], 3, 0), 1e-200 * base[:1], 1e200 * base[1:2]])
    x = x[rng.permutation(len(x))]
    u = x / np.abs(x).max(1)[:, None]
    u /= np.linalg.norm(u, axis=1)[:, None]
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    label = embedding_covertree.forest(len(x), *np.nonzero(link))
    monkeypatch.setattr(embedding_covertree, "BLOCK", 64)
    monkeypatch.setattr(embedding_covertree, "SMALL_ROWS", 0, raising=False)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    rows = embedding_covertree.near_duplicates(df).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in rows} == {k: (link[k].sum(), label[k]) for k in range(len(x))}
