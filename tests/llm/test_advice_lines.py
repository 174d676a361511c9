"""Line dedup: groups of look-alike lines that share buckets, and lines of few different shingles."""

import random

from doclens.llm import line_dedup

from .test_pairs import Union


def kept_lines(texts):
    sets = [frozenset(t[i : i + 8] for i in range(max(1, len(t) - 7))) for t in texts]
    group = Union()
    for i, a in enumerate(sets):
        group.find(i)
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b) - 1e-9:
                group.join(i, j)
    return {i for i in range(len(texts)) if group.find(i) == i}


def test_groups_that_share_buckets(frame):
    rng = random.Random(11)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)).replace("  ", "xy")
    common, texts = "q" + letters(230), []
    for _ in range(150):
        line, at = f"{common}{letters(36)}q", rng.randrange(20, 90)
        texts += [line, f"{line[:at]}#{line[at + 1:at + 90]}~{line[at + 91:]}"]
    rng.shuffle(texts)
    want = kept_lines(texts)
    assert len(want) == 150
    got = {r.doc_id for r in line_dedup.dedup_lines(frame(texts)).collect() if r.n_kept_lines}
    assert got == want


def test_blocks_of_a_bucket(frame, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK", 16)
    test_groups_that_share_buckets(frame)


def test_few_different_shingles(frame):
    texts = ["=" * 60, "=" * 100, "| --- " * 8, "| --- " * 20, "der " * 25, "der " * 30]
    texts += [c * n for c in "-_*.~#+" for n in (90, 120)]
    got = {r.doc_id for r in line_dedup.dedup_lines(frame(texts)).collect() if r.n_kept_lines}
    assert got == kept_lines(texts) == set(range(0, len(texts), 2))
