"""Near-duplicate embeddings: dual traversal of cover trees, exact.

On unit vectors a cosine of at least t is a distance of at most tau = sqrt(2 - 2t). The top of the tree are pivots,
chosen farthest-first from a bounded sample; every vector goes to the cell of its nearest one, large cells into blocks by
a hash. Each block becomes a cover tree: nested levels of centres whose radii halve, down to about tau; its lowest nodes
are given the smallest radius around their mean. Trees are packed, and every pack is written once; each pair of
packs meets in a task that reads both from the shared folder, so that no vector is sent to its partners by a shuffle.

A pair of trees is walked downwards together. A node reaches a tree only if it lies as near to that tree's pivot as the
tree's own nodes do, less tau and the radii: that holds for one node in a few, and is asked of both sides. A pair of
nodes with centres further apart than both radii and tau holds no link (first by a bound from a projection, then by all
dimensions); one that lies within tau, radii included, holds nothing but links; the points of what is left are decided by
the cosine in double precision.

A task returns counts of links and a spanning forest of them, not the links; equal vectors are one point with a
multiplicity. So a vector that a third of the rows repeat, or nearly do, costs no more rows than any other. On vectors
that lie evenly in many dimensions the pairs of nodes to be bounded still grow faster than the input.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclens.llm.components import connected_components
from doclens.llm.store import give_back, materialise

THRESHOLD = 0.95
BLOCK = 1024  # vectors of a tree
SAMPLE = 2  # vectors for each pivot, from which they are chosen; any choice gives the same links
MAX_CELLS = 8192
PIECE = 512  # nodes of a tree, in the order of their nearness to the pivot, that are bounded together
PACK_BYTES, PACKS = 16_000_000, 32  # of vectors in a pack at most; packs at least, if there are as many trees
SIDES = 24  # parts into which packs are dealt: so many squared tasks
PREFIX = 32  # dimensions of the projection; with so many, unrelated nodes seldom pass
SMALL_ROWS = 500_000  # of 32 bytes
SLACK = 1e-5  # single precision is rounded; bounds are loosened by more than that


def tau(threshold: float) -> float:
    return float(np.sqrt(max(0.0, 2 - 2 * threshold)))


def unit(vectors: np.ndarray) -> np.ndarray:
    v = np.asarray(vectors, np.float64)
    square = np.einsum("ij,ij->i", v, v)
    if len(v) and not 1e-250 < square.min() <= square.max() < 1e250:  # squares that vanish or overflow
        far = ~((square > 1e-250) & (square < 1e250))
        v = v.copy()
        v[far] /= np.abs(v[far]).max(1)[:, None]
        square = np.einsum("ij,ij->i", v, v)
    return v / np.sqrt(square)[:, None]


class CoverTree:
    """levels[l]: for each point the centre (a point) of its node; radius[l]: by centre, the covering radius."""

    def __init__(self, x: np.ndarray, smallest: float):
        self.x = x
        n = len(x)
        gram = x @ x.T
        at = np.arange(n)
        node = np.zeros(n, np.int64)
        self.levels, self.radius = [node], [self._radii(gram, node)]
        r = 1.0
        while r > smallest:
            new = at.copy()
            order = np.argsort(node, kind="stable")
            starts = np.flatnonzero(np.concatenate([[True], node[order][1:] != node[order][:-1]]))
            for group in np.split(order, starts[1:]):
                if len(group) == 1:
                    continue
                centre = node[group[0]]  # nested: a centre stays one below
                rest = group
                while len(rest):
                    near = (gram[centre, rest] >= 1 - r * r / 2) | (rest == centre)
                    new[rest[near]] = centre
                    rest = rest[~near]
                    if len(rest):
                        centre = rest[0]
            node = new
            self.levels.append(node)
            self.radius.append(self._radii(gram, node))
            r /= 2

    @staticmethod
    def _radii(gram: np.ndarray, node: np.ndarray) -> np.ndarray:
        least = np.full(len(node), 1.0)
        np.minimum.at(least, node, gram[node, np.arange(len(node))])
        return np.sqrt(np.maximum(0.0, 2 - 2 * least))


def _products(a: tuple, b: tuple, u: np.ndarray, v: np.ndarray, most: int = 200_000):
    """Child pairs of node pairs (u, v), and whether the pair is a node with itself. A node pair with many child pairs
    gives a grid (children of u as a column, of v as a row), the others lists of about ``most`` pairs."""
    sizes = a[1][u] * b[1][v]
    for k in np.flatnonzero(sizes >= 4096):
        p = a[2][a[0][u[k]] : a[0][u[k]] + a[1][u[k]]]
        q = b[2][b[0][v[k]] : b[0][v[k]] + b[1][v[k]]]
        for s in range(0, len(p), 1024):  # at most 1024 rows of a grid at once
            yield p[s : s + 1024, None], q[None, :], bool(u[k] == v[k])
    small = sizes < 4096
    u, v, sizes = u[small], v[small], sizes[small]
    piece = np.cumsum(sizes) // most
    for k in np.unique(piece):
        i = piece == k
        p, q, n = u[i], v[i], sizes[i]
        pair = np.repeat(np.arange(len(p)), n)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        wide = b[1][q][pair]
        yield a[2][a[0][p][pair] + at // wide], b[2][b[0][q][pair] + at % wide], (p == q)[pair]


def forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n points the least point that the links reach."""
    label = np.arange(n)
    while True:
        before = label.copy()
        least = np.minimum(label[u], label[v])
        np.minimum.at(label, u, least)
        np.minimum.at(label, v, least)
        label = label[label]
        if (label == before).all():
            return label


class Pack:
    """Trees of one vector length, written once. x: vectors as given, node after node; start, size, radius, centre of
    the lowest nodes, in pieces that begin at ``piece`` and whose pivots are ``cell``."""

    def __init__(self, trees: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], pivots: np.ndarray, smallest: float):
        parts = [[] for _ in range(8)]
        points = nodes = 0
        for cell, ids, n, x in trees:
            v = unit(x)
            centre_of = CoverTree(v, smallest).levels[-1]
            own, node = np.unique(centre_of, return_inverse=True)
            size = np.bincount(node)
            mean = np.zeros((len(own), v.shape[1]))
            np.add.at(mean, node, v)
            length = np.sqrt(np.einsum("ij,ij->i", mean, mean))
            mean = np.where((length > 1e-9)[:, None], mean / np.maximum(length, 1e-9)[:, None], v[own])
            mean = np.where((size == 1)[:, None], v[own], mean)
            far = np.zeros(len(own))
            gap = v - mean[node]
            np.maximum.at(far, node, np.sqrt(np.einsum("ij,ij->i", gap, gap)))
            by_pivot = np.argsort(-(mean @ pivots[cell]), kind="stable")
            rank = np.empty(len(own), np.int64)
            rank[by_pivot] = np.arange(len(own))
            order = np.argsort(rank[node], kind="stable")
            size, mean, far = size[by_pivot], mean[by_pivot], far[by_pivot]
            begin = np.arange(0, len(own), PIECE)
            several = size > 1
            for part, value in zip(parts, (ids[order], n[order], x[order], size, np.where(several, far + 1e-6, 0.0), mean[several].astype(np.float32), nodes + begin, np.full(len(begin), cell))):
                part.append(value)
            points, nodes = points + len(ids), nodes + len(own)
        self.ids, self.n, self.x, self.size, self.radius, self.centre, self.piece, self.cell = (np.concatenate(x) for x in parts)

    def open(self, pivots: np.ndarray, projection: np.ndarray | None) -> Pack:
        """With what can be had from the rest: unit vectors of the nodes, their projections, the bound of each piece."""
        self.start = np.cumsum(self.size) - self.size
        self.weight = np.add.reduceat(self.n, self.start)
        self.c = unit(self.x[self.start]).astype(np.float32)
        self.c[self.size > 1] = self.centre
        self.short = self.c
        if projection is not None:
            low = self.c @ projection
            rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", low, low)))
            self.short = np.concatenate([low, rest[:, None]], axis=1)
        ends = np.append(self.piece[1:], len(self.size))
        home = np.einsum("ij,ij->i", self.c, pivots[np.repeat(self.cell, ends - self.piece)])
        self.least = np.minimum.reduceat(home - self.radius, self.piece)
        self.ends = ends
        return self

    def products(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.start, self.size, np.arange(len(self.ids))


def projection(dim: int) -> np.ndarray | None:
    """Orthonormal columns, the same everywhere; none if that would spare nothing."""
    if dim < 2 * PREFIX:
        return None
    return np.linalg.qr(np.random.default_rng(0).normal(size=(dim, PREFIX)))[0].astype(np.float32)


def node_pairs(a: Pack, b: Pack, pivots: np.ndarray, reach: float):
    """u, v, d: nodes of a and of b that may hold a link, and the cosine of their centres; each pair once where a is b."""
    near_a = a.c @ pivots[b.cell].T + a.radius[:, None].astype(np.float32) >= (b.least - reach - SLACK).astype(np.float32)
    near_b = near_a if a is b else b.c @ pivots[a.cell].T + b.radius[:, None].astype(np.float32) >= (a.least - reach - SLACK).astype(np.float32)
    for i, (s, e) in enumerate(zip(a.piece, a.ends)):
        for j in range(i if a is b else 0, len(b.piece)):
            u = s + np.flatnonzero(near_a[s:e, j])
            v = b.piece[j] + np.flatnonzero(near_b[b.piece[j] : b.ends[j], i])
            if not len(u) or not len(v):
                continue
            r, most = a.radius[u], b.radius[v].max()
            limit = 1 - np.minimum(2.0, reach + r + most) ** 2 / 2 - SLACK
            grid = a.short[u] @ b.short[v].T
            if grid.max() < limit.min():
                continue
            p, q = np.divmod(np.flatnonzero((grid >= limit[:, None].astype(np.float32)).ravel()), len(v))  # faster than in two dimensions
            if a is b and i == j:
                p, q = p[u[p] < v[q]], q[u[p] < v[q]]
            if len(p) > 0.05 * grid.size:
                d = (a.c[u] @ b.c[v].T)[p, q]
            else:
                d = np.concatenate([np.zeros(0, np.float32), *(np.einsum("ij,ij->i", a.c[u[p[k : k + 50_000]]], b.c[v[q[k : k + 50_000]]]) for k in range(0, len(p), 50_000))])
            u, v = u[p], v[q]
            near = d >= 1 - np.minimum(2.0, reach + a.radius[u] + b.radius[v]) ** 2 / 2 - SLACK
            if near.any():
                yield u[near], v[near], d[near].astype(np.float64)


def _decided(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows p of a and q of b, as a grid or as lists, with a cosine of threshold or more."""
    if p.ndim == 2:
        near = unit(a[p[:, 0]]) @ unit(b[q[0]]).T >= threshold - 1e-9
        i, j = np.nonzero(near)
        p, q = p[i, 0], q[0, j]
    exact = [np.zeros(0, bool)]
    for s in range(0, len(p), 50_000):
        exact.append(np.einsum("ij,ij->i", unit(a[p[s : s + 50_000]]), unit(b[q[s : s + 50_000]])) >= threshold)
    exact = np.concatenate(exact)
    return p[exact], q[exact]


def linked(a: Pack, b: Pack, pivots: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, label, n: points of a or b with links between the two (each pair once where a is b), a point that they reach,
    and how many vectors each is linked with."""
    same, reach = a is b, tau(threshold)
    offset = 0 if same else len(a.ids)
    ids, weight = (a.ids, a.n) if same else (np.concatenate([a.ids, b.ids]), np.concatenate([a.n, b.n]))
    counts = np.zeros(len(ids), np.int64)
    edges, held = [], 0

    def join(u: np.ndarray, v: np.ndarray) -> None:
        nonlocal edges, held
        edges.append((u, v))
        held += len(u)
        if held > 4_000_000:
            label = forest(len(ids), *(np.concatenate(x) for x in zip(*edges)))
            moved = np.flatnonzero(label != np.arange(len(ids)))
            edges, held = [(moved, label[moved])], len(moved)

    def decide(u: np.ndarray, v: np.ndarray) -> None:
        """By the points of node pairs; of a node with itself, each pair once."""
        for p, q, alike in _products(a.products(), b.products(), u, v):
            i, j = _decided(a.x, b.x, p, q, threshold)
            if same:
                # pairs of a node with itself come twice, and each point with itself
                own = np.repeat(np.arange(len(a.size)), a.size)
                new = (own[i] != own[j]) | (i < j)
                i, j = i[new], j[new]
            j = j + offset
            counts[:] += np.bincount(i, weight[j], len(ids)).astype(np.int64) + np.bincount(j, weight[i], len(ids)).astype(np.int64)
            join(i, j)

    whole = np.zeros(len(a.size) + (0 if same else len(b.size)), np.int64)  # links of every point of a node
    nodes = 0 if same else len(a.size)
    for u, v, d in node_pairs(a, b, pivots, reach):
        inside = np.sqrt(np.maximum(0, 2 - 2 * d) + 4 * SLACK) + a.radius[u] + b.radius[v] <= reach - SLACK
        i, j = u[inside], v[inside]
        np.add.at(whole, i, b.weight[j])
        np.add.at(whole, j + nodes, a.weight[i])
        join(a.start[i], b.start[j] + offset)
        decide(u[~inside], v[~inside])
    size = a.size if same else np.concatenate([a.size, b.size])
    first = a.start if same else np.concatenate([a.start, b.start + offset])
    node = np.repeat(np.arange(len(size)), size)
    if same:
        inside = 2 * a.radius <= reach - SLACK
        counts += np.where(inside[node], a.weight[node] - a.n, 0)
        k = np.flatnonzero(~inside)
        decide(k, k)
    else:
        inside = np.zeros(len(size), bool)
    # the points of a node that is linked as a whole are joined through its first
    told = np.flatnonzero(((inside | (whole > 0)) & (size > 1))[node])
    join(told, first[node[told]])
    counts += whole[node]
    label = forest(len(ids), *(np.concatenate(x) for x in zip(*edges)))
    touched = np.flatnonzero((counts > 0) | (label != np.arange(len(ids))))
    return ids[touched], ids[label[touched]], counts[touched]


def condensed(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row an id: its counts summed, and the least id that the labels reach."""
    a, b, n = (np.concatenate(x) for x in zip(*found))
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    counts = np.zeros(len(ids), np.int64)
    np.add.at(counts, u, n)
    return ids, ids[forest(len(ids), u, v)], counts


def _vectors(batch, column: int):
    """For each vector length in a batch: the length, the rows that have it, their vectors."""
    lists = batch.column(column)
    flat, size = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    start = np.cumsum(size) - size
    for dim in np.unique(size):
        i = np.flatnonzero(size == dim)
        yield int(dim), i, flat[start[i][:, None] + np.arange(dim)]


def _nearest(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The pivot of each vector; a few at a time, as there may be many pivots."""
    x = unit(x).astype(np.float32)
    return np.concatenate([(x[s : s + 1024] @ pivots.T).argmax(1) for s in range(0, len(x), 1024)])


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors(vec_id, embedding).

    A vector that is null, empty or zero, has a null or non-finite component, or whose vec_id is null, is linked with
    nothing and is its own component; so are vectors of different lengths with each other. Equal vectors in several
    rows are linked like others, rows with the same vec_id are one component. Other columns, such as labels, are not
    read; an empty table gives none. Equal vectors are told by 128 bits of hash."""
    spark = vectors.sparkSession
    kind = vectors.schema["embedding"].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    width = np.float32 if kind == "array<float>" else np.float64
    own = vectors.select("vec_id", F.col("embedding").cast(kind).alias("embedding"))
    sound = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    valid = own.where(F.coalesce(sound, F.lit(False))).select("vec_id", "embedding", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))
    keyed = valid.select("vec_id", "h1", "h2")
    repeated = materialise(keyed.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).where("n > 1"), "repeated")
    few = repeated.count() <= SMALL_ROWS
    small = F.broadcast if few else (lambda df: df)
    points = valid.join(small(repeated), ["h1", "h2"], "left").where("rep IS NULL OR rep = vec_id").select(F.col("vec_id").alias("rep"), F.coalesce("n", F.lit(1)).alias("n"), "h1", "embedding")
    points = points if few else materialise(points, "points")

    total = vectors.count()
    cells = int(min(MAX_CELLS, max(1, -(-total // BLOCK))))
    pivots: dict[int, np.ndarray] = {}
    part = max(1, total // max(2048, SAMPLE * cells))
    sample = points.where(F.pmod(F.xxhash64("rep"), F.lit(part)) == 0).select("embedding").toPandas()["embedding"]  # about 2 * MAX_CELLS rows at most
    sample = {d: unit(np.stack([np.asarray(x) for x in sample if len(x) == d])).astype(np.float32) for d in {len(x) for x in sample}}
    for dim, x in sample.items():
        chosen, worst = [0], x @ x[0]
        while len(chosen) < min(cells, len(x)) and worst.min() < 1 - 1e-6:
            chosen.append(int(worst.argmin()))
            worst = np.maximum(worst, x @ x[chosen[-1]])
        pivots[dim] = x[chosen]
    shared = spark.sparkContext.broadcast(pivots)

    def of(dim: int) -> np.ndarray:
        """A length without pivots is one cell around the first axis."""
        p = shared.value.get(dim)
        return np.eye(1, dim, dtype=np.float32) if p is None else p

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            for dim, _, x in _vectors(batch, 0):
                cell, n = np.unique(_nearest(x, of(dim)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), dim, np.int32)), pa.array(cell), pa.array(n)], names=["dim", "cell", "n"])

    # at most MAX_CELLS rows for each vector length
    sizes = points.select("embedding").mapInArrow(count, "dim int, cell bigint, n bigint").groupBy("dim", "cell").agg(F.sum("n").alias("n")).orderBy("dim", "cell").collect()
    plan: dict[int, dict[int, tuple[int, list[int]]]] = {}  # of each cell: its first block, and the packs of its blocks
    packs, block, last, room = 0, 0, None, 0
    for r in sizes:
        most = max(1, min(PACK_BYTES // (r.dim * width().itemsize), max(BLOCK, -(-total // PACKS))))
        blocks = -(-r.n // BLOCK)
        own_packs = []
        for _ in range(blocks):
            if r.dim != last or room < r.n // blocks:
                packs, last, room = packs + 1, r.dim, most
            room -= r.n // blocks
            own_packs.append(packs)
        plan.setdefault(r.dim, {})[r.cell] = (block, own_packs)
        block += blocks
    dealt = spark.sparkContext.broadcast(plan)

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            for dim, i, x in _vectors(batch, 3):
                cell, h = _nearest(x, of(dim)), batch.column(2).to_numpy()[i]
                where = [(p[1][k := int(y) % len(p[1])], p[0] + k) for c, y in zip(cell, h) for p in (dealt.value[dim][int(c)],)]
                pack, at = (np.array(w, np.int64) for w in zip(*where))
                data = np.ascontiguousarray(x, width)
                columns = [pa.array(np.full(len(i), dim, np.int32)), pa.array(pack), pa.array(at), pa.array(cell), pa.array(batch.column(0).to_numpy()[i]), pa.array(batch.column(1).to_numpy()[i]), pa.array([row.tobytes() for row in data], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["dim", "pack", "block", "cell", "rep", "n", "data"])

    def packed(batches):
        import pyarrow as pa

        def written(key, trees):
            pack = Pack(trees, of(key[0]), tau(threshold) * 0.51)
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([pickle.dumps(pack, protocol=5)], pa.binary())], names=["dim", "pack", "data"])

        def tree(rows):
            unlike = {data: (rep, n) for rep, n, data in sorted(rows, reverse=True)}  # a row that is there twice is one
            ids, n = (np.array(x, np.int64) for x in zip(*unlike.values()))
            return ids, n, np.frombuffer(b"".join(unlike), width).reshape(len(ids), -1)

        key, block, rows, trees = None, None, [], []
        for batch in batches:
            for dim, pack, at, cell, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if block is not None and at != block[0]:
                    trees.append((block[1], *tree(rows)))
                    rows = []
                if key is not None and (dim, pack) != key:
                    yield written(key, trees)
                    trees = []
                key, block = (dim, pack), (at, cell)
                rows.append(tuple(row))
        if rows:
            yield written(key, [*trees, (block[1], *tree(rows))])
        give_back()

    def walk(batches):
        import pyarrow as pa

        def rows(found):
            return pa.RecordBatch.from_arrays([pa.array(x) for x in condensed(found)], names=["a", "b", "n"])

        found, held, left, a = [], 0, None, None
        lower = {}
        for batch in batches:
            for k in range(batch.num_rows):
                dim, i, j = (batch.column(c)[k].as_py() for c in range(3))
                if dim not in lower:
                    lower = {dim: projection(dim)}
                if left != i:
                    left, a = i, pickle.loads(batch.column(3)[k].as_buffer()).open(of(dim), lower[dim])
                b = a if i == j else pickle.loads(batch.column(4)[k].as_buffer()).open(of(dim), lower[dim])
                found.append(linked(a, b, of(dim), threshold))
                held += len(found[-1][0])
                if held > 2_000_000:
                    found = [condensed(found)]
                    held = len(found[0][0]) // 2
        if held:
            yield rows(found)
        give_back()

    table = points.select("rep", "n", "h1", "embedding").mapInArrow(place, "dim int, pack bigint, block bigint, cell bigint, rep bigint, n bigint, data binary")
    table = table.repartition("dim", "pack").sortWithinPartitions("dim", "pack", "block").mapInArrow(packed, "dim int, pack bigint, data binary")
    table = materialise(table, "packs").coalesce(max(1, min(SIDES, packs // 4)))
    # each pair of packs once, and about as many of them wherever two parts meet
    i, j = F.col("i"), F.col("j")
    once = (F.col("left_dim") - F.col("dim") == 0) & ((i == j) | ((i < j) == ((i + j) % 2 == 0)))
    pairs = table.select(F.col("dim").alias("left_dim"), F.col("pack").alias("i"), F.col("data").alias("x")).hint("shuffle_replicate_nl").join(table.select("dim", F.col("pack").alias("j"), F.col("data").alias("y")), once)
    met = materialise(pairs.select("dim", "i", "j", "x", "y").mapInArrow(walk, "a bigint, b bigint, n bigint"), "links")
    direct = met.groupBy("a").agg(F.sum("n").alias("others")).where("others > 0").withColumnRenamed("a", "rep")
    copied = materialise(repeated.join(direct, "rep", "left").select("h1", "h2", "rep", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "copied")
    equal = keyed.join(small(copied), ["h1", "h2"]).select("vec_id", "rep", "n_links")
    edges = met.select("a", "b").unionByName(equal.select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    components = connected_components(edges, "vectors")

    linked_rows = equal.select("vec_id", "n_links").unionByName(direct.select(F.col("rep").alias("vec_id"), F.col("others").alias("n_links"))).groupBy("vec_id").agg(F.max("n_links").alias("n_links"))
    out = vectors.select("vec_id").join(linked_rows.withColumnRenamed("vec_id", "of"), F.col("vec_id") == F.col("of"), "left").join(components, F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
