"""Leaf-wise gradient boosting of several models at once, with patience, and what each feature adds to a row's margin.

Rows are (model, role, x, y): a model's training rows and its validation rows, x an
array of numbers. Values become bins; a pass over the binned rows gives histograms of
gradients for every open leaf of every model, summed by (model, leaf, block of
features) where the best split is found too, so the driver gets a few numbers for each leaf.
Sums are integers, so no result depends on how the rows are dealt.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagegrid.operators import ranking
from triagegrid.session import discard, persisted

UNIT = float(1 << 20)
BLOCK = 16
EVERY = 10


class Settings(NamedTuple):
    """rounds of trees at most; patience: rounds without a better validation precision before a model is left; the rest is each tree's."""

    rounds: int = 600
    step: float = 0.03
    leaves: int = 31
    least: int = 40
    row_share: float = 0.8
    column_share: float = 0.8
    ridge: float = 1.0
    least_hessian: float = 1e-3
    patience: int = 50
    bins: int = 255
    seed: int = 42


class Tree(NamedTuple):
    """Nodes as arrays, the root first. A leaf's feature is -1. Rows of a value up to `at` (of a bin up to `bin`) go left; cover counts the training rows."""

    feature: np.ndarray
    bin: np.ndarray
    at: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray

    def leaves_of(self, table: np.ndarray, cut: np.ndarray) -> np.ndarray:
        node, every = np.zeros(len(table), np.int64), np.arange(len(table))
        while True:
            f = self.feature[node]
            inner = f >= 0
            if not inner.any():
                return node
            down = np.where(table[every, np.maximum(f, 0)] <= cut[node], self.left[node], self.right[node])
            node = np.where(inner, down, node)


class Ensemble(NamedTuple):
    """A fitted model: where margins start, its trees, how many were fitted, and the validation precision of every prefix that was measured."""

    start: float
    trees: list[Tree]
    fitted: int
    precision: list[float]
    width: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((t.value[t.leaves_of(x, t.at)] for t in self.trees), np.zeros(len(x)))

    def expected(self) -> float:
        """The mean margin by cover: what contributions add up from."""
        return self.start + sum(float((t.value * t.cover)[t.feature < 0].sum() / t.cover[0]) for t in self.trees)

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """Path-dependent Shapley values of every feature: rows add up to the margin less expected()."""
        out = np.zeros((len(x), self.width))
        for t in self.trees:
            _shapley(t, x, out)
        return out

    def gains(self) -> np.ndarray:
        """Gain of all splits by feature."""
        out = np.zeros(self.width)
        for t in self.trees:
            inner = t.feature >= 0
            np.add.at(out, t.feature[inner], t.gain[inner])
        return out


def _shapley(tree: Tree, x: np.ndarray, out: np.ndarray) -> None:
    """Add one tree's Shapley values of all rows to out.

    A leaf sees a row through the features on its path. Feature i lets the row
    through (one_i, 0 or 1) if it is known, and the share zero_i of the training rows if it is not.
    Coefficient k of the product of (zero_i + one_i t) sums up the ways to know k of
    them; a Shapley value weighs those of all features but its own, which leave the
    product by division. Work per leaf grows with the square of its path's features.
    """
    stack: list[tuple[int, dict]] = [(0, {})]
    while stack:
        node, path = stack.pop()
        f = int(tree.feature[node])
        if f >= 0:
            left = x[:, f] <= tree.at[node]
            for child, goes in ((tree.left[node], left), (tree.right[node], ~left)):
                one, zero = path.get(f, (np.ones(len(x), bool), 1.0))
                stack.append((int(child), path | {f: (one & goes, zero * float(tree.cover[child] / tree.cover[node]))}))
            continue
        d = len(path)
        if not d:
            continue
        poly = np.zeros((d + 1, len(x)))
        poly[0] = 1.0
        for n, (one, zero) in enumerate(path.values()):
            poly[1 : n + 2] = poly[1 : n + 2] * zero + poly[: n + 1] * one
            poly[0] *= zero
        weight = [math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) for k in range(d)]
        for feature, (one, zero) in path.items():
            known = np.zeros(len(x))
            rest = np.zeros(len(x))
            for k in range(d - 1, -1, -1):
                rest = np.where(one, poly[k + 1] - zero * rest, poly[k] / zero)
                known += weight[k] * rest
            out[:, feature] += known * (one - zero) * tree.value[node]


class Growing:
    """A tree that grows best split first. Splits are tried before it is known whether they will be taken; finish() keeps those that are."""

    def __init__(self, settings: Settings):
        self.s = settings
        self.left: list[int] = [-1]
        self.split: list[tuple[int, int] | None] = [None]
        self.gain: list[float] = [0.0]
        self.sums: list[tuple[int, int, int]] = [(0, 0, 0)]
        self.low: list[tuple[int, int, int]] = [(0, 0, 0)]
        self.pending = [0]
        self.taken: list[int] = []

    def told(self, node: int, sums: tuple[int, int, int], gain: float, split: tuple[int, int] | None, low: tuple[int, int, int]) -> None:
        self.sums[node], self.gain[node], self.split[node], self.low[node] = sums, gain, split, low

    def extend(self) -> None:
        """Take splits by gain as far as gains are known; what their leaves hold is to be looked at next (pending)."""
        self.pending, self.taken = [], []
        heap = [(-self.gain[0], 0)]
        while heap and len(self.taken) + 1 < self.s.leaves:
            gain, node = heapq.heappop(heap)
            if gain >= 0 or self.split[node] is None:
                break
            self.taken.append(node)
            if self.left[node] < 0:
                self.left[node] = len(self.left)
                rest = tuple(a - b for a, b in zip(self.sums[node], self.low[node]))
                for sums in (self.low[node], rest):
                    child = len(self.left)
                    self.left.append(-1)
                    self.split.append(None)
                    self.gain.append(0.0)
                    self.sums.append(sums)
                    self.low.append((0, 0, 0))
                    # Whatever has fewer rows cannot be split.
                    if sums[2] >= 2 * self.s.least:
                        self.pending.append(child)
            else:
                for child in (self.left[node], self.left[node] + 1):
                    if self.gain[child] > 0:
                        heapq.heappush(heap, (-self.gain[child], child))

    def routes(self) -> Tree:
        """All splits tried so far, to find each row's open leaf."""
        n = len(self.left)
        inner = [self.left[i] >= 0 for i in range(n)]
        feature = np.array([self.split[i][0] if inner[i] else -1 for i in range(n)])
        cut = np.array([self.split[i][1] if inner[i] else 0 for i in range(n)])
        left = np.array(self.left)
        none = np.zeros(0)
        return Tree(feature, cut, none, left, left + 1, none, none, none)

    def finish(self, edges: Sequence[np.ndarray]) -> Tree:
        number, order = {0: 0}, [0]
        for node in order:
            if node in self.taken:
                for child in (self.left[node], self.left[node] + 1):
                    number[child] = len(order)
                    order.append(child)
        taken = set(self.taken)
        inner = [i in taken for i in order]
        pick = lambda f, other: np.array([f(i) if t else other for i, t in zip(order, inner)])
        worth = np.array([-self.s.step * (self.sums[i][0] / UNIT) / (self.sums[i][1] / UNIT + self.s.ridge) for i in order])
        return Tree(
            pick(lambda i: self.split[i][0], -1), pick(lambda i: self.split[i][1], 0), pick(lambda i: float(edges[self.split[i][0]][self.split[i][1]]), 0.0), pick(lambda i: number[self.left[i]], -1), pick(lambda i: number[self.left[i] + 1], -1),
            np.where(inner, 0.0, worth), np.array([self.sums[i][2] for i in order], float), pick(lambda i: self.gain[i], 0.0),
        )


def bin_edges(rows: DataFrame, widths: dict[int, int], bins: int) -> dict[int, list[np.ndarray]]:
    """For every model and feature the values at which bins end, by approximate quantiles of the training rows; the last bin is open. At most bins numbers a feature."""
    places = F.array(*[F.lit(i / bins) for i in range(bins)])
    value = lambda i: F.coalesce(F.get("x", F.lit(i)), F.lit(float("nan")))
    aggs = [F.percentile_approx(F.when(~F.isnan(value(i)), value(i)), places, 20 * bins).alias(f"q{i}") for i in range(max(widths.values()))]
    out = {}
    for r in rows.where("role = 'train'").groupBy("model").agg(*aggs).collect():
        out[r["model"]] = [np.unique(np.array(r[f"q{i}"] or [], float)) for i in range(widths[r["model"]])]
    return out


def _values(column: pa.Array, width: int) -> np.ndarray:
    """An array column as a table; what is missing is below every number. Arrays of another length: ValueError."""
    flat = column.flatten()
    if len(flat) != width * len(column):
        raise ValueError(f"arrays must have {width} numbers")
    x = flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
    return np.where(np.isnan(x), -np.inf, x)


def _by_model(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    for m in pc.unique(batch.column("model")).to_pylist():
        yield m, batch.filter(pc.equal(batch.column("model"), m))


def _bins(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, width)


def _drawn(keys: np.ndarray, turn: int, share: float, seed: int) -> np.ndarray:
    """Whether each row takes part in a turn, by its key."""
    h = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (turn + 1) + seed) % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))) >> np.uint64(11) < np.uint64(int(share * (1 << 53)))


def fit(spark: SparkSession, rows: DataFrame, settings: Settings = Settings()) -> dict[int, Ensemble]:
    """Fit every model of rows(model, role, key, x, y) at once.

    role is train or validation, key a number by which rows are drawn, y 0 or 1. Rows of the
    rarer class weigh as much as the other class together. After each EVERY
    rounds all new prefixes of all models are measured on validation rows; a
    model whose best prefix is patience rounds old is left, and its best prefix kept. Of
    equal ones the shortest. Without validation rows of both classes all rounds
    are fitted and kept. A model whose training rows are of one class: ValueError.
    """
    s = settings
    totals = rows.where("role = 'train'").groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p"), F.max(F.size("x")).alias("width")).collect()
    if not totals or any(not 0 < r["p"] < r["n"] for r in totals):
        raise ValueError("the training rows of a model are of one class")
    widths = {r["model"]: r["width"] for r in totals}
    edges = bin_edges(rows, widths, s.bins)
    start = {r["model"]: math.log(r["p"] / (r["n"] - r["p"])) for r in totals}
    heavy = {r["model"]: (1.0, (r["n"] - r["p"]) / r["p"]) if r["p"] * 2 <= r["n"] else (r["p"] / (r["n"] - r["p"]), 1.0) for r in totals}

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m, b in _by_model(batch):
                x = _values(b.column("x"), widths[m])
                table = np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges[m])], 1).astype(np.uint8) if widths[m] else np.zeros((len(b), 0), np.uint8)
                yield pa.RecordBatch.from_arrays([b.column("model"), b.column("role"), b.column("key"), b.column("y"), pa.array(np.full(len(b), start[m])), pa.array([r.tobytes() for r in table], pa.binary())], names=["model", "role", "key", "y", "f", "bins"])

    schema = "model int, role string, key bigint, y int, f double, bins binary"
    state = persisted(spark, rows.select(F.col("model").cast("int").alias("model"), "role", F.col("key").cast("bigint").alias("key"), "x", F.col("y").cast("int").alias("y")).mapInArrow(binned, schema), "boost").persist()
    trees: dict[int, list[Tree]] = {m: [] for m in widths}
    precision: dict[int, list[float]] = {m: [] for m in widths}
    open_, since = set(widths), 0
    for turn in range(s.rounds):
        fresh = {m: trees[m][since:] for m in open_}
        grown = _grow(state, open_, fresh, turn, widths, edges, heavy, s)
        for m, tree in grown.items():
            trees[m].append(tree)
        if (turn + 1 - since) % EVERY and turn + 1 < s.rounds:
            continue
        fresh = {m: trees[m][since:] for m in open_}
        for m, more in _measure(state, fresh, since, widths).items():
            precision[m] += more
        for m in list(open_):
            best = _best(precision[m])
            if best is not None and turn - best >= s.patience:
                open_.discard(m)
        if not open_ or turn + 1 == s.rounds:
            break
        state, since = _advanced(spark, state, fresh, widths, schema), turn + 1
    state.unpersist()
    discard(spark, state)
    out = {}
    for m in widths:
        best = _best(precision[m])
        out[m] = Ensemble(start[m], trees[m] if best is None else trees[m][: best + 1], len(trees[m]), precision[m], widths[m])
    return out


def _best(precision: list[float]) -> int | None:
    return int(np.argmax(precision)) if precision else None


def _grow(state: DataFrame, models: set[int], fresh: dict[int, list[Tree]], turn: int, widths: dict, edges: dict, heavy: dict, s: Settings) -> dict[int, Tree]:
    """One more tree for each model: passes over the rows until every split that is taken was the best one open."""
    grow = {m: Growing(s) for m in models}
    columns = {m: np.sort(np.random.default_rng((s.seed, turn)).choice(widths[m], max(1, round(s.column_share * widths[m])), replace=False)) for m in models}
    size = {m: np.array([len(edges[m][c]) + 1 for c in columns[m]]) for m in models}
    while any(g.pending for g in grow.values()):
        asked = {m: (g.routes(), np.array(g.pending)) for m, g in grow.items() if g.pending}

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for m, b in _by_model(batch):
                    if m not in asked:
                        continue
                    table, f = _bins(b, widths[m]), b.column("f").to_numpy().copy()
                    mine = _drawn(b.column("key").to_numpy(), turn, s.row_share, s.seed)
                    routes, pending = asked[m]
                    place = np.full(len(routes.feature), -1)
                    place[pending] = np.arange(len(pending))
                    leaf = place[routes.leaves_of(table, routes.bin)]
                    mine &= leaf >= 0
                    table, leaf, f, y = table[mine], leaf[mine], f[mine], b.column("y").to_numpy()[mine]
                    for t in fresh[m]:
                        f += t.value[t.leaves_of(table, t.bin)]
                    p = 1 / (1 + np.exp(-f))
                    w = np.where(y == 1, heavy[m][1], heavy[m][0])
                    offset = np.append(0, np.cumsum(size[m]))
                    # Whole numbers, so that sums are the same in any order.
                    parts = [np.rint((p - y) * w * UNIT), np.rint(p * (1 - p) * w * UNIT), np.ones(len(y))]
                    held = sums.setdefault(m, np.zeros((len(pending), 3, offset[-1]), np.int64))
                    for j, c in enumerate(columns[m]):
                        slot = leaf * size[m][j] + table[:, c]
                        for k, v in enumerate(parts):
                            held[:, k, offset[j] : offset[j + 1]] += np.bincount(slot, v, len(pending) * size[m][j]).reshape(len(pending), -1).astype(np.int64)
            out: list[tuple] = []
            for m, held in sums.items():
                offset = np.append(0, np.cumsum(size[m]))
                for i, node in enumerate(asked[m][1].tolist()):
                    if held[i, 2].any():
                        for lo in range(0, len(columns[m]), BLOCK):
                            hi = min(lo + BLOCK, len(columns[m]))
                            out.append((m, node, lo, held[i, :, offset[lo] : offset[hi]].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["model", "node", "block", "sums"])

        def best(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, node, lo = (k.as_py() for k in key)
            total = None
            for b in batches:
                for raw in b.column("sums").to_pylist():
                    got = np.frombuffer(raw, np.int64).reshape(3, -1)
                    total = got.copy() if total is None else total + got
            top = (0.0, -1, -1, 0, 0, 0)
            at = 0
            for j in range(lo, min(lo + BLOCK, len(columns[m]))):
                part = total[:, at : at + size[m][j]]
                at += size[m][j]
                whole = part.sum(1)
                low = np.cumsum(part, 1)[:, :-1]
                high = whole[:, None] - low
                fine = (low[2] >= s.least) & (high[2] >= s.least) & (low[1] >= s.least_hessian * UNIT) & (high[1] >= s.least_hessian * UNIT)
                if fine.any():
                    score = lambda v: (v[0] / UNIT) ** 2 / (v[1] / UNIT + s.ridge)
                    gain = np.where(fine, score(low) + score(high) - score(whole), -np.inf)
                    i = int(np.argmax(gain))
                    if gain[i] > top[0]:
                        top = (float(gain[i]), int(columns[m][j]), i, *(int(v) for v in low[:, i]))
            row = (m, node, *(int(v) for v in total[:, : size[m][lo]].sum(1)), *top)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["model", "node", "g", "h", "n", "gain", "feature", "bin", "lg", "lh", "ln"])

        train = state.where((F.col("role") == "train") & F.col("model").isin(*asked)).select("model", "key", "y", "f", "bins")
        held = train.mapInArrow(partial, "model int, node int, block int, sums binary").groupBy("model", "node", "block")
        found: dict[tuple, tuple] = {}
        for r in held.applyInArrow(best, "model int, node int, g bigint, h bigint, n bigint, gain double, feature int, bin int, lg bigint, lh bigint, ln bigint").collect():
            now = (r["gain"], -r["feature"], r)
            key = (r["model"], r["node"])
            if key not in found or now[:2] > found[key][:2]:
                found[key] = now
        for (m, node), (gain, _, r) in found.items():
            grow[m].told(node, (r["g"], r["h"], r["n"]), gain, (r["feature"], r["bin"]) if gain > 0 else None, (r["lg"], r["lh"], r["ln"]))
        for m in asked:
            grow[m].extend()
    return {m: g.finish(edges[m]) for m, g in grow.items()}


def _measure(state: DataFrame, fresh: dict[int, list[Tree]], since: int, widths: dict) -> dict[int, list[float]]:
    """Average precision on validation rows of every prefix that ends in one of the fresh trees; none for models without rows of both classes."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m, b in _by_model(batch):
                table, f = _bins(b, widths[m]), b.column("f").to_numpy().copy()
                for k, t in enumerate(fresh[m]):
                    f = f + t.value[t.leaves_of(table, t.bin)]
                    yield pa.RecordBatch.from_arrays([b.column("model"), pa.array(np.full(len(b), since + k, np.int32)), b.column("y"), pa.array(f)], names=["model", "k", "y", "score"])

    rows = state.where((F.col("role") == "validation") & F.col("model").isin(*fresh)).select("model", "y", "f", "bins")
    blocks = ranking.tied_blocks(rows.mapInArrow(prefixes, "model int, k int, y int, score double"), "score", "y", by=["model", "k"])
    out: dict[int, list[float]] = {m: [] for m in fresh}
    for r in sorted(blocks.groupBy("model", "k").agg(ranking.average_precision().alias("ap")).collect(), key=lambda r: r["k"]):
        if r["ap"] is not None:
            out[r["model"]].append(r["ap"])
    return out


def _advanced(spark: SparkSession, state: DataFrame, fresh: dict[int, list[Tree]], widths: dict, schema: str) -> DataFrame:
    """The rows of the models that go on, with margins that hold the fresh trees, written anew."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m, b in _by_model(batch):
                table, f = _bins(b, widths[m]), b.column("f").to_numpy().copy()
                for t in fresh[m]:
                    f = f + t.value[t.leaves_of(table, t.bin)]
                yield b.set_column(4, "f", pa.array(f))

    new = persisted(spark, state.where(F.col("model").isin(*fresh)).mapInArrow(add, schema), "boost").persist()
    new.count()
    state.unpersist()
    discard(spark, state)
    return new


def score(rows: DataFrame, models: dict[int, Ensemble], contributions: bool = False) -> DataFrame:
    """rows(model, x, ...) with margin by the row's model, and with contributions: an array, a number for each feature.

    Rows of a model that is not there have null. What the models weigh does not grow with the data.
    """
    kept = rows.columns
    schema = rows.select("*", F.lit(0.0).alias("margin"), *([F.array(F.lit(0.0)).alias("contributions")] if contributions else [])).schema
    for field in schema[len(kept) :]:
        field.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m, b in _by_model(batch):
                if m not in models:
                    more = [pa.nulls(len(b), pa.float64()), pa.nulls(len(b), pa.list_(pa.float64()))]
                else:
                    x = _values(b.column("x"), models[m].width)
                    more = [pa.array(models[m].margin(x)), pa.array(list(models[m].contributions(x)), pa.list_(pa.float64())) if contributions else None]
                yield pa.RecordBatch.from_arrays([*b.columns, *more[: 1 + contributions]], names=[*kept, *["margin", "contributions"][: 1 + contributions]])

    return rows.mapInArrow(run, schema)


def platt(scored: DataFrame, turns: int = 25) -> dict[int, tuple[float, float]]:
    """(a, b) by model so that sigmoid(a * margin + b) is the probability, from scored(model, margin, y); (1, 0) where one class is missing.

    Newton steps for all models at once; each is one pass that sends back six sums a model.
    """
    at = {r["model"]: [1.0, 0.0, not 0 < r["p"] < r["n"]] for r in scored.groupBy("model").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n")).collect()}
    for _ in range(turns):
        left = {m: v for m, v in at.items() if not v[2]}
        if not left:
            break
        ab = lambda i: F.coalesce(*[F.when(F.col("model") == m, float(v[i])) for m, v in left.items()])  # noqa: E731, B023
        p = 1 / (1 + F.exp(-(ab(0) * F.col("margin") + ab(1))))
        r, w = p - F.col("y"), p * (1 - p)
        m_ = F.col("margin")
        sums = scored.where(F.col("model").isin(*left)).groupBy("model").agg(F.sum(r * m_).alias("ga"), F.sum(r).alias("gb"), F.sum(w * m_ * m_).alias("haa"), F.sum(w * m_).alias("hab"), F.sum(w).alias("hbb"))
        for q in sums.collect():
            # A little on the diagonal keeps separable classes finite.
            haa, hbb = q["haa"] + 1e-6, q["hbb"] + 1e-6
            det = haa * hbb - q["hab"] ** 2
            da, db = (hbb * q["ga"] - q["hab"] * q["gb"]) / det, (haa * q["gb"] - q["hab"] * q["ga"]) / det
            size = max(abs(da), abs(db))
            shrink = min(1.0, 4.0 / size) if size else 1.0
            v = at[q["model"]]
            v[0], v[1], v[2] = v[0] - shrink * da, v[1] - shrink * db, size < 1e-9
    return {m: (v[0], v[1]) for m, v in at.items()}


def save(spark: SparkSession, models: dict[int, Ensemble], lines: dict[int, tuple[float, float]], path: str) -> None:
    """Models and their calibration as two tables under path, which may be on any store: a row for each model, a row for each tree."""
    heads = [(m, e.start, e.fitted, e.width, e.precision, *lines.get(m, (1.0, 0.0))) for m, e in models.items()]
    spark.createDataFrame(heads, "model int, start double, fitted int, width int, precision array<double>, a double, b double").coalesce(1).write.mode("overwrite").parquet(f"{path}/models")
    kinds = ("int", "int", "double", "int", "int", "double", "double", "double")
    rows = [(m, i, *(a.tolist() for a in t)) for m, e in models.items() for i, t in enumerate(e.trees)]
    schema = "model int, tree int, " + ", ".join(f"{n} array<{k}>" for n, k in zip(Tree._fields, kinds))
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")


def load(spark: SparkSession, path: str) -> tuple[dict[int, Ensemble], dict[int, tuple[float, float]]]:
    """What save() wrote: the models, and (a, b) of each."""
    trees: dict[int, list[Tree]] = {}
    for r in sorted(spark.read.parquet(f"{path}/trees").collect(), key=lambda r: (r["model"], r["tree"])):
        trees.setdefault(r["model"], []).append(Tree(*(np.array(r[n], int if n in ("feature", "bin", "left", "right") else float) for n in Tree._fields)))
    heads = spark.read.parquet(f"{path}/models").collect()
    models = {r["model"]: Ensemble(r["start"], trees.get(r["model"], []), r["fitted"], list(r["precision"]), r["width"]) for r in heads}
    return models, {r["model"]: (r["a"], r["b"]) for r in heads}
