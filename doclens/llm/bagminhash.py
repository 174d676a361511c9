"""Near-duplicate documents by BagMinHash over multisets of word shingles.

A shingle that occurs w times owns the weights (0, w]. Its axis of weights is cut into the dyadic intervals (0, 1],
(1, 2], (2, 4], (4, 8], ..., and each interval has a Poisson process of its width's rate, seeded by shingle and
interval, whose points carry a time, a weight and one of ``REGISTERS`` registers. Points of weight at most w count.
The earliest point of each register is the signature: two multisets agree in a register with probability sum of
minima over sum of maxima, exactly the weighted Jaccard similarity, and large weights cost only their logarithm.
Points are generated up to a time by which every register has one almost surely; where one has none the time is
raised for that document.

Signatures are banded. Documents that share a bucket, directly or through others, form a family; within families
the multisets themselves are compared. A family is dealt into blocks of bounded size by a hash of doc_id, and each
pair of blocks is compared in one task by sparse products, which returns a spanning forest of the links at most; so
pairs are never listed and no family, however large, meets in one task. Equal multisets are one vertex from the start.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclens.llm.components import connected_components
from doclens.llm.store import give_back, materialise

WIDTH = 5
THRESHOLD = 0.8
REGISTERS, ROWS = 128, 4  # 32 bands of 4: a pair at 0.8 shares none with probability 5e-8
BLOCK_DOCS, BLOCK_ITEMS = 512, 300_000
SMALL = 400_000  # family members that may be broadcast: some 40 bytes each
_WORD = re.compile(r"\w+").findall
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _times(n: int, x: np.uint64) -> np.uint64:
    return np.uint64(n * int(x) & 0xFFFFFFFFFFFFFFFF)


class Shingler:
    """Texts to hashed shingles; the hash of a word is kept, up to ``size`` words."""

    def __init__(self, width: int = WIDTH, size: int = 200_000):
        from xxhash import xxh3_64_intdigest

        self.width, self.size, self.hash, self.known = width, size, xxh3_64_intdigest, {}

    def shingles(self, text: str | None) -> np.ndarray:
        """A hash for each run of ``width`` lower-cased words; of one to width - 1 words, one for all of them."""
        words = _WORD(text.lower()) if text else []
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > self.size:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.hash(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.width, len(h))
        out = h[: len(h) - k + 1].copy()
        for i in range(1, k):
            out = out * _A + h[i : len(h) - k + 1 + i]
        return _mix(out + np.uint64(k))


def multiset(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles, return_counts=True)


def expanded(shingles: np.ndarray) -> np.ndarray:
    """The multiset as a set: the c-th occurrence of a shingle is an element of its own."""
    s = np.sort(shingles)
    if not len(s):
        return s
    new = np.concatenate([[True], s[1:] != s[:-1]])
    at = np.arange(len(s))
    copy = at - np.maximum.accumulate(np.where(new, at, 0))
    return np.where(copy > 0, _mix(s + copy.astype(np.uint64) * _A), s)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """An id of the earliest point for each multiset and register; 0 in all registers of an empty one."""
    out = np.zeros((len(bags), registers), np.uint64)
    todo = np.array([i for i, (s, _) in enumerate(bags) if len(s)])
    factor = np.log(registers) + 5.0
    while len(todo):
        total = np.array([bags[i][1].sum() for i in todo], np.float64)
        limit = factor * registers / total
        element = np.concatenate([bags[i][0] for i in todo])
        weight = np.concatenate([bags[i][1] for i in todo]).astype(np.float64)
        owner = np.repeat(np.arange(len(todo)), [len(bags[i][0]) for i in todo])
        # processes: interval 0 is (0, 1], interval k is (2^(k-1), 2^k]
        seeds, owners, lows, widths, weights = [], [], [], [], []
        k = 0
        while len(element):
            low = 0.0 if k == 0 else 2.0 ** (k - 1)
            keep = weight > low
            element, weight, owner = element[keep], weight[keep], owner[keep]
            seeds.append(_mix(element + _times(k + 1, _A)))
            owners.append(owner)
            lows.append(np.full(len(element), low))
            widths.append(np.full(len(element), 1.0 if k == 0 else low))
            weights.append(weight)
            k += 1
        seed, who, low, width, w = map(np.concatenate, (seeds, owners, lows, widths, weights))
        time = np.zeros(len(seed))
        found = []
        i = 0
        while len(seed):
            i += 1
            point = _mix(seed + _times(i, _C))
            u = ((point >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53
            time = time - np.log(u) / width
            keep = time <= limit[who]
            seed, who, low, width, w, time, point = (x[keep] for x in (seed, who, low, width, w, time, point))
            more = _mix(point + _A)
            place = low + width * ((more >> np.uint64(11)).astype(np.float64) * 2.0**-53)
            counts = place < w
            found.append((who[counts] * registers + (more[counts] & np.uint64(registers - 1)).astype(np.int64), time[counts], point[counts]))
        cell, times, points = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((times, cell))
        cell, points = cell[order], points[order]
        first = np.concatenate([[True], cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, bool)
        got = np.zeros(len(todo) * registers, np.uint64)
        has = np.zeros(len(todo) * registers, bool)
        got[cell[first]] = points[first]
        has[cell[first]] = True
        full = has.reshape(len(todo), registers).all(1)
        out[todo[full]] = got.reshape(len(todo), registers)[full]
        todo, factor = todo[~full], factor * 2
    return out


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash for each band of ``rows`` registers, its number mixed in."""
    parts = signature.reshape(len(signature), -1, rows)
    out = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64) * _A, parts.shape[:2]).copy()
    for r in range(rows):
        out = _mix(out * _B + parts[:, :, r])
    return out


def links_between(items: list[np.ndarray], side: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """A spanning forest of the pairs (x, y) whose sets overlap by threshold or more: pairs of the two sides, or all
    pairs where there is but one side. Sets must not be empty."""
    n = len(items)
    size = np.array([len(x) for x in items], np.float64)
    flat = np.concatenate(items)
    owner = np.repeat(np.arange(n), size.astype(int))
    values, back, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[back] > 1
    back, owner = back[shared], owner[shared]
    order = np.argsort(back, kind="stable")
    back, owner = back[order], owner[order]
    column = np.cumsum(np.concatenate([[0], back[1:] != back[:-1]])) if len(back) else back
    inter = np.zeros((n, n), np.float32)
    step = max(256, 2_000_000 // n)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        i, j = np.searchsorted(column, [a, a + step])
        dense = np.zeros((n, step), np.float32)
        dense[owner[i:j], column[i:j] - a] = 1
        inter += dense @ dense.T
    similar = inter >= threshold * (size[:, None] + size[None, :] - inter) - 1e-6
    two = side.min() != side.max()
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(*np.nonzero(np.triu(similar, 1))):
        if not two or side[x] != side[y]:
            p, q = find(int(x)), find(int(y))
            if p != q:
                root[p] = q
                out.append((int(x), int(y)))
    return out


# -- over Spark --------------------------------------------------------------------------------------------------


def signature_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_items, key (equal for equal multisets), bands of every row with an id and a word."""

    def run(batches):
        import pyarrow as pa

        own = Shingler()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(ids):
                bags, kept, chars = [], [], 0
                while at < len(ids) and len(bags) < 512 and chars < 2_000_000:
                    text = texts[at].as_py()
                    s = own.shingles(text)
                    if len(s):
                        bags.append(multiset(s))
                        kept.append(ids[at])
                    chars += len(text or "")
                    at += 1
                if not bags:
                    continue
                b = bands(signatures(bags))
                keys = [int(n.sum()).to_bytes(5, "big") + (_mix(s) * n.astype(np.uint64)).sum().tobytes() + (_mix(s ^ _C) * n.astype(np.uint64)).sum().tobytes() for s, n in bags]
                flat = pa.array(b.astype(np.int64).ravel())
                offsets = pa.array(np.arange(0, b.size + 1, b.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kept, pa.int64()), pa.array([int(n.sum()) for _, n in bags], pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(offsets, flat)],
                    names=["doc_id", "n_items", "key", "bands"],
                )
        del own
        give_back()

    return docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()).mapInArrow(run, "doc_id bigint, n_items bigint, key binary, bands array<bigint>")


def verified_links(docs: DataFrame, families: DataFrame) -> DataFrame:
    """a, b: links within families(doc_id, family, n_items), a spanning forest of each pair of blocks."""
    size = families.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n_items") / BLOCK_ITEMS)).cast("int").alias("blocks"))
    members = families.join(size, "family").select("doc_id", "family", "blocks", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block"))
    members = materialise(members, "members")
    small = members.count() <= SMALL
    rows = docs.select("doc_id", "text").join(F.broadcast(members) if small else members, "doc_id")

    def dealt(batches):
        """family, i, j, side, doc_id, items: once for each pair of blocks that the document is in."""
        import pyarrow as pa

        own = Shingler()
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            out, size = [], 0

            def made():
                family, i, j, side, doc, items = zip(*out)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in items])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(items).view(np.int64)))
                return pa.RecordBatch.from_arrays([pa.array(family, pa.int64()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(side, pa.int32()), pa.array(doc, pa.int64()), lists], names=["family", "i", "j", "side", "doc_id", "items"])

            for doc, text, family, blocks, block in zip(*columns):
                items = expanded(own.shingles(text))
                if not len(items):
                    continue
                for other in range(blocks):
                    out.append((family, min(block, other), max(block, other), block, doc, items))
                    size += len(items)
                    if size > 500_000:
                        yield made()
                        out, size = [], 0
            if out:
                yield made()
        del own
        give_back()

    def compared(batches):
        import pyarrow as pa

        group, docs_, sides, items = None, [], [], []

        def links():
            pairs = links_between(items, np.array(sides)) if len(items) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([docs_[x] for x, _ in pairs], pa.int64()), pa.array([docs_[y] for _, y in pairs], pa.int64())], names=["a", "b"])

        for batch in batches:
            family, i, j, side, doc = (batch.column(c).to_numpy() for c in range(5))
            lists = batch.column(5)
            values, offsets = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
            for r in range(batch.num_rows):
                here = (family[r], i[r], j[r])
                if here != group:
                    if len(items) > 1:
                        yield links()
                    group, docs_, sides, items = here, [], [], []
                docs_.append(int(doc[r]))
                sides.append(int(side[r]))
                items.append(values[offsets[r] : offsets[r + 1]].copy())
        if len(items) > 1:
            yield links()

    parts = rows.select("doc_id", "text", "family", "blocks", "block").mapInArrow(dealt, "family bigint, i int, j int, side int, doc_id bigint, items array<bigint>")
    return parts.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "side").mapInArrow(compared, "a bigint, b bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, kept for every row of docs(doc_id, text): documents linked by a weighted Jaccard similarity of
    THRESHOLD or more of their five-word shingles, directly or through others, have the smallest doc_id among them as
    class_id; kept is whether that is the document's own.

    A document without words is like no other. Rows with the same doc_id are one document and have one class. A null
    doc_id has a null class and is kept. Other columns are not read; an empty table gives none."""
    features = materialise(signature_table(docs), "signatures")
    first = features.groupBy("key").agg(F.min(F.struct("doc_id", "n_items", "bands")).alias("r"))
    first = materialise(first.select("key", "r.*"), "representatives")
    equal = features.join(first.select("key", F.col("doc_id").alias("rep")), "key").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    buckets = materialise(first.select("doc_id", F.posexplode("bands").alias("band", "hash")), "buckets")
    hubs = buckets.groupBy("band", "hash").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    candidates = buckets.join(hubs, ["band", "hash"]).select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).where("a <> b").distinct()
    families = connected_components(candidates, "families").select(F.col("id").alias("doc_id"), F.col("component").alias("family"))
    families = families.join(first.groupBy("doc_id").agg(F.sum("n_items").alias("n_items")), "doc_id")
    links = materialise(verified_links(docs, families).where("a <> b"), "near-links")
    classes = connected_components(equal.unionByName(links), "classes").select(F.col("id").alias("linked"), "component")
    out = docs.select("doc_id").join(classes, F.col("doc_id") == F.col("linked"), "left")
    class_id = F.coalesce("component", "doc_id")
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce(class_id == F.col("doc_id"), F.lit(True)).alias("kept"))
