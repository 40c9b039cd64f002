"""Embedding near-dedup: exact threshold pairs by dual traversal of cover trees with halving radii."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagegrid.llm.common import connected_components, delete, discard, ensure_workers, materialize, release, shared_dir

THRESHOLD = 0.95
SMALLEST = 1 / 32
BLOCK = 4096
SAMPLE = 2048
FAN = 64
DEPTH = 24
SLACK = 1e-7
PAIRS = 1 << 20
DENSE = 0.02  # share of pairs from which a product costs less than looking at each
HELD_TREES, HELD_CENTRES = 8, 1024  # files that a task keeps of those it read


def net(x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(centres, owner): rows more than radius apart from each other that cover all rows, first come first; nearest centre of each row."""
    owner = np.full(len(x), -1)
    centres: list[int] = []
    limit = 1 - radius * radius / 2  # distance <= radius, as a dot product of unit vectors
    best = np.full(len(x), -2.0)
    while (open_ := np.flatnonzero(owner < 0)).size:
        # Rows not covered yet, a batch at a time: take those that no earlier one of the batch covers.
        batch = open_[:512]
        near = x[batch] @ x[batch].T >= limit
        taken: list[int] = []
        free = np.ones(len(batch), bool)
        for i in range(len(batch)):
            if free[i]:
                taken.append(i)
                free &= ~near[i]
        rows = batch[taken]
        dots = x @ x[rows].T
        at = dots.argmax(1)
        top = dots[np.arange(len(x)), at]
        better = (top > best) & (top >= limit)
        owner[better] = len(centres) + at[better]
        best[better] = top[better]
        owner[rows] = len(centres) + np.arange(len(rows))
        best[rows] = 2.0
        centres += rows.tolist()
    return np.array(centres), owner


class Tree:
    """Cover tree of unit vectors: levels of nodes with radii 1, 1/2, 1/4 ..., each level's nodes children of the level above.

    A node is a row, its centre, and the rows it covers; the centre is the centre
    of one of its own children too. Rows are ordered so that the members of every
    node stand together, the centre first. Levels end where every node is one row
    or the radius is SMALLEST.
    """

    def __init__(self, x: np.ndarray):
        groups = [np.arange(len(x))]
        self.shape, starts, radius = [], [], 1.0
        while True:
            finer = []
            for rows in groups:
                if len(rows) == 1:
                    finer.append(rows)
                    continue
                centres, owner = net(x[rows], radius)
                first = np.ones(len(rows), bool)
                first[centres] = False
                order = np.lexsort((first, owner))
                finer += np.split(rows[order], np.flatnonzero(np.diff(owner[order])) + 1)
            groups = finer
            starts.append(np.array([len(g) for g in groups]))
            if len(groups) == len(x) or radius <= SMALLEST:
                break
            radius /= 2
        self.order = np.concatenate(groups)
        # Groups of every level stand in the order of the last one, as each level only splits those above.
        self.shape = [(np.cumsum(size) - size, size) for size in starts]
        self.fill(x[self.order])

    def fill(self, x: np.ndarray) -> None:
        """Rows in order, and what follows from them: each level's parents, first rows, which are the centres, sizes and covering radii."""
        self.x, self.levels, above = x, [], np.zeros(1, int)
        for start, size in self.shape:
            dots = np.einsum("ij,ij->i", x, np.repeat(x[start], size, axis=0))
            reach = np.where(size > 1, _distance(np.minimum.reduceat(dots, start)), 0.0)
            self.levels.append((np.searchsorted(above, start, "right") - 1, start, size, x[start], reach))
            above = start


def _distance(dot: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * dot)) + SLACK


def _strips(level: tuple, other: tuple) -> Iterator[tuple[int, int]]:
    """Ranges of a level's nodes that make PAIRS pairs with another's at most, or are one node."""
    step = max(1, PAIRS // len(other[1]))
    for lo in range(0, len(level[1]), step):
        yield lo, min(len(level[1]), lo + step)


def _chunks(p: np.ndarray, q: np.ndarray, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(p, q), so many at a time that their vectors take PAIRS numbers a side."""
    step = max(1, PAIRS // dim)
    for lo in range(0, len(p), step):
        yield p[lo : lo + step], q[lo : lo + step]


def _marked(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero of two dimensions, several times as fast."""
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


def _open_pairs(la: tuple, lb: tuple, above: np.ndarray, tau: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(p, q): pairs of nodes of two levels whose parents are marked in above. Few are listed; of many a product, strip by strip, drops those too far apart.

    dot >= 1 - (ra + rb + c)^2 / 2 is one product of vectors with two more numbers. It is
    taken in single precision, less what rounding may take away, so no pair is lost.
    """
    if np.count_nonzero(above) <= DENSE * above.size:
        up, vp = _marked(above)
        from_a, from_b = (np.searchsorted(level[0], np.arange(n + 1)) for level, n in zip((la, lb), above.shape))
        wide = np.diff(from_b)[vp]
        ends = np.cumsum(np.diff(from_a)[up] * wide)
        total = int(ends[-1]) if len(ends) else 0
        if total <= DENSE * len(la[1]) * len(lb[1]):
            for lo in range(0, total, PAIRS):
                k = np.arange(lo, min(lo + PAIRS, total))
                at = np.searchsorted(ends, k, "right")
                k -= np.where(at, ends[at - 1], 0)
                yield from_a[up[at]] + k // wide[at], from_b[vp[at]] + k % wide[at]
            return
    c = tau + 4 * SLACK
    own = la[4] + c
    x = np.column_stack([la[3], own, np.ones(len(own))]).astype(np.float32)
    y = np.column_stack([lb[3], lb[4], lb[4] * lb[4] / 2]).astype(np.float32).T
    least = 1 - own * own / 2
    least = (least - (x.shape[1] + 8) * 2.0**-20 * (1 + own)).astype(np.float32)[:, None]
    for lo, hi in _strips(la, lb):
        mask = above[la[0][lo:hi]][:, lb[0]]
        share = np.count_nonzero(mask)
        if share > DENSE * mask.size:
            mask &= x[lo:hi] @ y >= least[lo:hi]
        if share:
            p, q = _marked(mask)
            yield p + lo, q


class Found(NamedTuple):
    """Links between places of two trees: pairs (p, q), or with whole all pairs of the ranges [p, p + np) and [q, q + nq)."""

    p: np.ndarray
    q: np.ndarray
    np: np.ndarray | None = None
    nq: np.ndarray | None = None


def dual_pairs(a: Tree, b: Tree, same: bool, threshold: float = THRESHOLD) -> Iterator[Found]:
    """Places (i in a, j in b) with a dot product of at least threshold; of one tree with itself i < j, or whole nodes with themselves.

    Pairs of nodes go down both trees together. A pair whose centres lie farther
    apart than the covering radii and the threshold's distance is dropped with all
    below it; one whose farthest members are close enough is told as a whole. What
    is left at the last level is compared member by member. Pairs that stay open
    are marks of a byte each, and vectors of PAIRS numbers a side are looked at
    together, so memory is bounded by BLOCK whatever the radii leave.
    """
    tau = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    above = np.ones((1, 1), bool)
    deep = min(len(a.levels), len(b.levels))
    dim = a.x.shape[1]
    for k in range(deep):
        la, lb = a.levels[k], b.levels[k]
        below = np.zeros((len(la[1]), len(lb[1])), bool)
        for p_, q_ in _open_pairs(la, lb, above, tau):
            if same:
                p_, q_ = p_[p_ <= q_], q_[p_ <= q_]
            for p, q in _chunks(p_, q_, dim):
                apart = _distance(np.einsum("ij,ij->i", la[3][p], lb[3][q]))
                if same:
                    apart[p == q] = 0.0
                close = apart + la[4][p] + lb[4][q] + 4 * SLACK <= tau
                if close.any():
                    x, y = p[close], q[close]
                    yield Found(la[1][x], lb[1][y], la[2][x], lb[2][y])
                near = ~close & (apart <= la[4][p] + lb[4][q] + tau + SLACK)
                below[p[near], q[near]] = True
        above = below
    la, lb = a.levels[deep - 1], b.levels[deep - 1]
    # Members as a level below the last one: their parents are its nodes.
    nodes_a, nodes_b = (np.repeat(np.arange(len(level[1])), level[2]) for level in (la, lb))
    rows_a, rows_b = ((nodes, np.arange(len(nodes)), None, tree.x, np.zeros(len(nodes))) for nodes, tree in ((nodes_a, a), (nodes_b, b)))
    for p_, q_ in _open_pairs(rows_a, rows_b, above, tau) if above.any() else ():
        if same:
            good = (p_ < q_) | (nodes_a[p_] != nodes_b[q_])
            p_, q_ = p_[good], q_[good]
        for p, q in _chunks(p_, q_, dim):
            good = np.einsum("ij,ij->i", a.x[p], b.x[q]) >= threshold
            yield Found(p[good], q[good])


def _roots(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest place that links reach from each of n places."""
    root = np.arange(n)
    while True:
        before = root.copy()
        for p, q in pairs:
            low = np.minimum(root[p], root[q])
            np.minimum.at(root, p, low)
            np.minimum.at(root, q, low)
        root = root[root]
        if (root == before).all():
            return root


class Tally:
    """Links counted for the rows of two trees that stand one after the other, and a forest of what they connect."""

    def __init__(self, mult_a: np.ndarray, mult_b: np.ndarray, same: bool):
        self.shift = 0 if same else len(mult_a)
        self.mult = mult_a if same else np.concatenate([mult_a, mult_b])
        self.same, size = same, len(self.mult)
        self.sum = np.concatenate([[0], np.cumsum(self.mult)])
        self.count = np.zeros(size, np.int64)
        self.added, self.own = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
        self.root = np.arange(size)

    def add(self, found: Found) -> None:
        p, q = found.p, found.q + self.shift
        if not len(p):
            return
        size = len(self.mult)
        if found.np is None:
            self.count += np.bincount(p, self.mult[q], size).astype(np.int64) + np.bincount(q, self.mult[p], size).astype(np.int64)
            self._join(p, q)
            return
        p_end, q_end = p + found.np, q + found.nq
        self_ = (p == q) if self.same else np.zeros(len(p), bool)
        # Every row of a range gains what the other range weighs; in a node with itself all but its own.
        for at, end, gain in ((p, p_end, self.sum[q_end] - self.sum[q]), (q[~self_], q_end[~self_], (self.sum[p_end] - self.sum[p])[~self_])):
            np.add.at(self.added, at, gain)
            np.add.at(self.added, end, -gain)
        np.add.at(self.own, p[self_], 1)
        np.add.at(self.own, p_end[self_], -1)
        # One row of either side holds the other side together.
        for first, start, number in ((q, p, found.np), (p, q, found.nq)):
            which = np.repeat(np.arange(len(start)), number)
            place = start[which] + np.arange(len(which)) - np.repeat(np.cumsum(number) - number, number)
            self._join(first[which], place)

    def _join(self, p: np.ndarray, q: np.ndarray) -> None:
        at = np.flatnonzero(self.root != np.arange(len(self.root)))
        self.root = _roots(len(self.root), [(at, self.root[at]), (p, q)])

    def counts(self) -> np.ndarray:
        return self.count + np.cumsum(self.added)[:-1] - np.cumsum(self.own)[:-1] * self.mult


def _net_of_node(t: pa.Table, wanted: int) -> np.ndarray:
    """Centres for the children of a node, from a sample of its rows: the net of the largest radius of 1, 1/2, 1/4 ... with at least `wanted` of them, or the first `wanted`."""
    x = _units(_rows(t.column("v")))
    radius = 1.0
    while True:
        centres, _ = net(x, radius)
        if len(centres) >= wanted or radius < 1e-6:
            return x[centres[:wanted]]
        radius /= 2


def split_nodes(spark: SparkSession, reps: DataFrame) -> tuple[DataFrame, DataFrame | None, int]:
    """(rows with the leaf they stand in, nodes, levels): the upper part of the tree, down to leaves of BLOCK rows at most.

    reps(rep, mult, v, dim) start in one root for each dim. Level by level a node
    with more rows is given centres of children by a net over a bounded sample of
    its rows (about SAMPLE), and every row goes to the nearest; nodes(parent, node,
    centre, reach) has each child's covering radius, measured over all its rows.
    Where a node's rows cannot be told apart by distance its children share them by
    a hash and one centre. Centres are files of the shared folder, which tasks look
    up by node; rows carry a file's name only.
    """
    folder, moved = f"{shared_dir(spark)}/tree-centres-{uuid.uuid4().hex}", None
    placed, tree, depth = reps.select("rep", "mult", "v", F.col("dim").cast("string").alias("node")), None, 0
    while depth < DEPTH:
        big = placed.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
        big = materialize(spark, big, "tree-big")
        if big.isEmpty():
            break
        drawn = F.pmod(F.xxhash64("rep", F.lit(11 + depth)), F.lit(1_000_003)) * F.col("n") < F.lit(SAMPLE) * 1_000_003
        sample = placed.join(big, "node").where(drawn).select("node", "n", "v")

        def centres(t: pa.Table) -> pa.Table:
            x = _net_of_node(t, int(min(FAN, max(2, 2 * t.column("n")[0].as_py() // BLOCK))))
            if len(x) == 1:
                x = np.repeat(x, 2, axis=0)
            path = _put(folder, [x.tobytes()])
            return pa.table({"node": pa.array([t.column("node")[0].as_py()], pa.string()), "centres": pa.array([x.tolist()], pa.list_(pa.list_(pa.float64()))), "path": [path]})

        kids = materialize(spark, sample.groupBy("node").applyInArrow(centres, "node string, centres array<array<double>>, path string"), "tree-kids")

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = lru_cache(HELD_CENTRES)(lambda path: np.frombuffer(_get(path)[0]))
            for b in batches:
                vectors, own, paths = b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist()
                flat, size = vectors.flatten().to_numpy(), np.diff(vectors.offsets.to_numpy())
                start = np.cumsum(size) - size
                ids = b.column(0).to_numpy()
                met: dict[str, list[int]] = {}
                for n, path in enumerate(paths):
                    if path is not None:
                        met.setdefault(path, []).append(n)
                nodes, far = list(own), np.full(len(own), np.nan)
                for path, places in met.items():
                    at = np.array(places)
                    dim = size[at[0]]  # one for all rows of a node
                    centre = known(path).reshape(-1, dim)
                    dots = _units(flat[start[at][:, None] + np.arange(dim)]) @ centre.T
                    k = ids[at] % len(centre) if np.ptp(centre, axis=0).max() == 0 else dots.argmax(1)
                    far[at] = _distance(dots[np.arange(len(at)), k])
                    for n, child in zip(places, k.tolist()):
                        nodes[n] = f"{own[n]}.{child}"
                parents = [node if path is not None else None for node, path in zip(own, paths)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(nodes, pa.string()), pa.array(parents, pa.string()), pa.array(far, pa.float64(), from_pandas=True)], names=["rep", "mult", "v", "node", "parent", "far"])

        before, there = moved, kids.select("node", "path")
        moved = placed.join(there, "node", "left").select("rep", "mult", "v", "node", "path").mapInArrow(assign, "rep bigint, mult bigint, v array<double>, node string, parent string, far double")
        moved = materialize(spark, moved, "tree-placed")
        if before is not None:
            discard(spark, before)
        reach = moved.where("parent is not null").groupBy("parent", "node").agg(F.max("far").alias("reach"))
        named = kids.select(F.col("node").alias("p"), F.posexplode("centres").alias("k", "centre")).select(F.concat_ws(".", "p", "k").alias("node"), "centre")
        level = materialize(spark, reach.join(named, "node").select("parent", "node", "centre", "reach"), "tree-nodes")
        tree = level if tree is None else tree.union(level)
        placed, depth = moved.select("rep", "mult", "v", "node"), depth + 1
    if moved is not None:
        placed._shared_path = moved._shared_path
    return placed, tree, depth


def leaf_pairs(spark: SparkSession, leaves: DataFrame, tree: DataFrame | None, depth: int, threshold: float) -> DataFrame:
    """(i, j) of the leaves, i <= j, that covering radii cannot rule out: pairs of nodes go down the upper tree together, level by level."""
    roots = leaves.select(F.substring_index("node", ".", 1).alias("i")).distinct()
    none = F.lit(None).cast("array<double>")
    pairs = roots.select("i", F.col("i").alias("j"), none.alias("ic"), none.alias("jc"), F.lit(2.0).alias("ir"), F.lit(2.0).alias("jr"))
    tau = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    for at in range(depth):
        left = tree.select(F.col("parent").alias("i"), F.col("node").alias("ni"), F.col("centre").alias("nic"), F.col("reach").alias("nir"))
        right = tree.select(F.col("parent").alias("j"), F.col("node").alias("nj"), F.col("centre").alias("njc"), F.col("reach").alias("njr"))
        down = pairs.join(left, "i", "left").join(right, "j", "left").select(
            F.col("i").eqNullSafe(F.col("j")).alias("same"),
            *[F.coalesce(f"n{c}", c).alias(c) for c in ("i", "j", "ic", "jc", "ir", "jr")],
        )
        dot = F.aggregate(F.zip_with("ic", "jc", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        near = F.coalesce(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot)) <= F.col("ir") + F.col("jr") + tau + 4 * SLACK, F.lit(True))
        kept = ["i", "j"] if at == depth - 1 else pairs.columns  # no centres where no level is left
        pairs = materialize(spark, down.where(near & (~F.col("same") | (F.col("i") <= F.col("j")))).select(*kept), "tree-pairs")
    return pairs.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))


def links(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of vectors: (vec_id, n_links, component_id, kept).

    Vectors link by a cosine of at least threshold, in double precision.
    n_links counts other rows linked directly, component_id is the smallest id
    that links reach, kept says that this is the row's own. Null, empty and zero
    vectors and those with null or non-finite components link with nothing, nor
    do vectors of different lengths. A null id takes no part; its component is
    null and it is kept.

    Equal vectors go on as one with their number. A cover tree is grown over all
    vectors: its upper levels as tables (split_nodes), down to leaves of BLOCK rows,
    the rest within each leaf. Both are gone down twice at once: pairs of nodes that
    their covering radii rule out are dropped with all below them. The pairs of
    leaves that remain are traversed in tasks of their own, which send back counts
    and roots by row, never pairs. Leaves are files of the shared folder, one each,
    that these tasks read: what travels with a pair is two names, so disk grows with
    the rows whatever the radii leave.
    """
    ensure_workers(spark)
    src = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    good = F.coalesce(F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", finite) & F.exists("v", lambda c: c != 0), F.lit(False))
    src = materialize(spark, src.withColumn("v", F.when(good, F.col("v"))), "tree-vectors")
    reps = src.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult"))
    reps = materialize(spark, reps.select("rep", "mult", "v", F.size("v").alias("dim")), "tree-reps")
    total = reps.count()
    if not total:
        return src.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    placed, upper, depth = split_nodes(spark, reps)
    blocked = placed.withColumnRenamed("node", "block")

    def build(t: pa.Table) -> pa.Table:
        raw = _rows(t.column("v"))
        x = _units(raw)
        tree = Tree(x)
        raw = raw[tree.order]
        narrow = raw.astype(np.float32)
        raw = narrow if (narrow == raw).all() else raw  # as they were read, no wider than needed
        ids, mult = (t.column(c).to_numpy()[tree.order] for c in ("rep", "mult"))
        shape = [np.concatenate(s).astype("<i4").tobytes() for s in tree.shape]
        path = _put(folder, [ids.astype("<i8").tobytes(), mult.astype("<i8").tobytes(), raw.tobytes(), *shape])
        return pa.table({"block": t.column("block")[:1], "dim": pa.array([x.shape[1]], pa.int32()), "path": [path]})

    folder = f"{shared_dir(spark)}/tree-leaves-{uuid.uuid4().hex}"
    trees = blocked.select("block", "rep", "mult", "v").groupBy("block").applyInArrow(build, "block string, dim int, path string")
    trees = materialize(spark, trees, "tree-blocks")
    work = leaf_pairs(spark, blocked.select(F.col("block").alias("node")), upper, depth, threshold)
    if depth:
        discard(spark, placed)
    both = work.join(trees.select(F.col("block").alias("i"), "dim", F.col("path").alias("a")), "i").join(trees.select(F.col("block").alias("j"), F.col("path").alias("b")), "j")
    both = both.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "i", "j").sortWithinPartitions("i", "j")

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = lru_cache(HELD_TREES)(lambda path, dim: _load(_get(path), dim))
        for batch in batches:
            for dim, path_a, path_b in zip(*(batch.column(c).to_pylist() for c in range(3))):
                a, b, same = tree(path_a, dim), tree(path_b, dim), path_a == path_b
                ids = a.ids if same else np.concatenate([a.ids, b.ids])
                tally = Tally(a.mult, b.mult, same)
                for found in dual_pairs(a, b, same, threshold):
                    tally.add(found)
                count, root = tally.counts(), tally.root
                linked = np.flatnonzero(count)
                if not len(linked):
                    continue
                # By place: the smallest id of the class stands for it.
                low = np.full(len(ids), np.iinfo(np.int64).max)
                np.minimum.at(low, root, ids)
                yield pa.RecordBatch.from_arrays([pa.array(ids[linked], pa.int64()), pa.array(count[linked], pa.int64()), pa.array(low[root[linked]], pa.int64())], names=["rep", "n", "low"])

    found = materialize(spark, both.select("dim", "a", "b").mapInArrow(traverse, "rep bigint, n bigint, low bigint"), "tree-links")
    delete(spark, folder)
    release(spark)
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    classes = connected_components(spark, found.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    per = reps.select("rep", "mult", "v").join(counts, "rep", "left").join(classes.select(F.col("node").alias("rep"), "component"), "rep", "left")
    per = per.select(F.col("v").alias("__v"), (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).cast("bigint").alias("n_links"), F.coalesce("component", "rep").alias("c"))
    out = src.join(per, F.col("v") == F.col("__v"), "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def _units(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(-1, keepdims=True)
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def _load(parts: list[bytes], dim: int) -> Tree:
    tree = Tree.__new__(Tree)
    tree.ids, tree.mult = np.frombuffer(parts[0], "<i8"), np.frombuffer(parts[1], "<i8")
    tree.shape = [tuple(np.frombuffer(p, "<i4").astype(int).reshape(2, -1)) for p in parts[3:]]
    tree.fill(_units(np.frombuffer(parts[2], np.float32 if len(parts[2]) == 4 * dim * len(tree.ids) else np.float64).reshape(-1, dim)))
    return tree


def _rows(vectors: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as the rows of an array."""
    flat = np.concatenate([c.flatten().to_numpy() for c in vectors.chunks])
    return flat.reshape(len(vectors), -1)


def _put(folder: str, parts: list[bytes]) -> str:
    """Write some bytes to a file in folder and return its path. Every try has a name of its own; only what tries that ended return is read."""
    store, root = arrow_fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    name = uuid.uuid4().hex
    table = pa.table({"part": pa.array(parts, pa.large_binary())})
    with store.open_output_stream(f"{root}/{name}", compression=None) as out, pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return f"{folder}/{name}"


def _get(path: str) -> list[bytes]:
    store, name = arrow_fs.FileSystem.from_uri(path)
    with store.open_input_stream(name, compression=None) as f, pa.ipc.open_stream(f) as reader:
        return reader.read_all().column(0).to_pylist()
