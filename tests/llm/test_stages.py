"""Each stage of the pipeline on nulls, empty texts, repeated rows, no rows, and columns with the names that it uses."""

import random

import pytest

from .conftest import words

CLASHING = "n_lines n_kept_lines kept score predicted ids item_ids n_hit n_words class_id family bucket key row dropped label".split()


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("stages")
    rng = random.Random(5)
    spark.createDataFrame([(k, k % 2, 0) for k in range(20)] + [(None, 1, 0), (3, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, " ".join(words(rng, 14))), (1, None), (2, "")], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def documents(spark, rows):
    extra = "".join(f", {c} string" for c in CLASHING)
    return spark.createDataFrame([(i, t, *("x" for _ in CLASHING)) for i, t in rows], f"doc_id bigint, text string{extra}")


@pytest.mark.parametrize("stage", range(5))
def test_stage(spark, sf_dir, stage):
    import corpus_pipeline

    name, function = corpus_pipeline.STAGES[stage]
    rng = random.Random(6)
    texts = [" ".join(words(rng, 60)) for _ in range(4)]
    odd = [(None, None), (7, None), (8, ""), (9, texts[1]), (9, texts[1]), (None, texts[2]), (11, "\n \n"), (12, " ".join(words(rng, 20_000)))]
    docs = documents(spark, [*odd, (10, texts[3])])
    out = function(spark, docs, sf_dir)
    if name != "bpe":
        assert out.columns == docs.columns
        assert all(r[c] == "x" for r in out.collect() for c in CLASHING)
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    everything = sorted([*odd, (10, texts[3])], key=repr)
    if name == "bpe":
        assert got == sorted([(i, t or "") for i, t in everything], key=repr)
    elif name == "line_dedup":
        # of the repeated rows the first occurrence stays; both rows are the same, so both keep it
        assert got == everything
    elif name in ("decontaminate", "near_dedup"):
        assert got == everything
    else:
        assert set(got) <= set(everything)
    assert function(spark, documents(spark, []), sf_dir).count() == 0


def test_workers_get_small_batches(spark, sf_dir):
    """A task's rows must not come to its Python worker as one batch."""
    import corpus_pipeline
    from doclens.llm.store import BATCH_BYTES

    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat(CAST(id AS string), 1000) AS text").coalesce(1)

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"size": pa.array([batch.nbytes], pa.int64())})

    for name, function in corpus_pipeline.STAGES:
        if name in ("quality", "near_dedup", "bpe"):
            spark.conf.unset(BATCH_BYTES)
            try:
                function(spark, documents(spark, [(1, "one two")]), sf_dir)
                assert max(r.size for r in docs.mapInArrow(sizes, "size bigint").collect()) < 3_000_000
            finally:
                spark.conf.unset(BATCH_BYTES)


def test_forgotten_states_are_freed():
    """States point at each other; those forgotten must not wait for the garbage collector beside the new ones."""
    from doclens.llm.bpe_fst import BpeTransducer

    coder = BpeTransducer({bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257, b"abcd": 258}, max_states=3)
    old = coder.start
    assert [coder.encode(p) for p in (b"abab", b"abca", b"abcda", b"abcab")] == [(256, 256), (257, 97), (258, 97), (257, 256)]
    assert coder.start is not old and not old
