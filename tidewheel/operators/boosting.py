"""Second-order boosted trees over binned columns.

Columns are cut into bins once. A round of growth needs, for each open node,
column and bin, the sums of gradients and Hessians of the rows there. Each task
sums its own rows; these sums, whose size depends on nodes, columns and bins
alone, are added by node and column, and the best cut of each comes back. Rows
never move. Gradients are rounded to a fixed step, so sums are exact and trees
do not depend on how rows are partitioned.

Trees grow by levels to a depth, or best leaf first to a number of leaves. The
latter also takes a round for several leaves at once: the children of all leaves
that may be split next are summed together, and what turns out not to be needed
is dropped.

Up to ``PART_ROWS`` training rows are one partition, and its task takes all
rounds without a job for each; more rows take a job a round. Both make equal
trees.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.sources.shared import settled

#: Training rows up to which one task takes all rounds; beyond, rows of a partition.
PART_ROWS = 100_000
#: Trees after which each row's margin is written, so that later rounds evaluate few trees.
WRITTEN_TREES = 16
#: Gradients and Hessians are multiples of this.
STEP = 2.0**-24
LEAST_GAIN = 1e-6


@dataclass(frozen=True)
class Boosting:
    """What a fit is asked for. ``depth`` or ``leaves`` bounds a tree; ``rows`` and ``columns`` are the shares that a tree sees."""

    loss: str
    trees: int
    rate: float
    depth: int | None = None
    leaves: int | None = None
    l2: float = 0.0
    l1: float = 0.0
    least_hessian: float = 0.0
    least_rows: int = 1
    rows: float = 1.0
    columns: float = 1.0
    bins: int = 255
    #: trees without a better loss on held-out rows after which a fit ends; only from ``stop_from`` rows on
    patience: int | None = None
    hold_out: float = 0.1
    tolerance: float = 1e-7
    stop_from: int = 10_000
    seed: int = 42


@dataclass
class Tree:
    """Nodes by number; a leaf has no left child, a right child follows the left one."""

    feature: list[int] = field(default_factory=lambda: [0])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    #: the edge that ``bin`` stands for, once a tree is complete
    threshold: list[float] = field(default_factory=list)

    def split(self, node: int, cut: Cut) -> None:
        """Children of ``node``: the left one's number is kept, the right one's follows it."""
        self.feature[node], self.bin[node], self.left[node] = cut.feature, cut.bin, len(self.left)
        for _ in range(2):
            self.feature.append(0)
            self.bin.append(0)
            self.left.append(-1)
            self.value.append(0.0)


@dataclass(frozen=True)
class Cut:
    gain: float
    feature: int
    bin: int
    #: sums of gradients and Hessians on both sides
    left: tuple[float, float]
    right: tuple[float, float]


# ---------------------------------------------------------------- arithmetic of one part


def soft(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def gradients(loss: str, y: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if loss == "logistic":
        p = 1.0 / (1.0 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1.0 - p), STEP)
    elif loss == "squared":
        g, h = margin - y, np.ones(len(y))
    else:
        raise ValueError(f"unknown loss {loss!r}")
    return np.rint(g / STEP) * STEP, np.rint(h / STEP) * STEP


def losses(loss: str, y: np.ndarray, margin: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, margin) - y * margin if loss == "logistic" else 0.5 * (margin - y) ** 2


def shares(ids: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """A number in [0, 1) for each row and tree, whatever the partitioning; tree -1 tells held-out rows."""
    h = ids.view(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + (tree + 2) * 0xC2B2AE3D27D4EB4F) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return (h ^ (h >> np.uint64(31))).astype(np.float64) / 2.0**64


def columns_of(p: Boosting, features: int, tree: int) -> np.ndarray:
    """The columns that a tree may cut."""
    if p.columns >= 1:
        return np.arange(features)
    return np.sort(np.random.default_rng([p.seed, tree]).choice(features, max(1, round(p.columns * features)), replace=False))


def route(tree: Tree, bins: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Where rows end that stand at ``node``; ``bins`` has a row for each column."""
    feature, cut, left = np.array(tree.feature), np.array(tree.bin), np.array(tree.left)
    moving = np.flatnonzero(left[node] >= 0)
    while len(moving):
        at = node[moving]
        node[moving] = left[at] + (bins[feature[at], moving] > cut[at])
        moving = moving[left[node[moving]] >= 0]
    return node


def sums(bins: np.ndarray, slot: np.ndarray, g: np.ndarray, h: np.ndarray, slots: int, p: Boosting) -> np.ndarray:
    """Sums (three, slots, columns, bins) of gradients, Hessians and rows; slot -1 counts nowhere."""
    mine = np.flatnonzero(slot >= 0)
    if len(mine) < len(slot):
        bins, slot, g, h = bins[:, mine], slot[mine], g[mine], h[mine]
    base, width = slot * p.bins, p.bins
    out = np.zeros((3, slots, len(bins), width))
    for i, column in enumerate(bins):
        key = base + column

        def by_bin(weight, key=key):
            return np.bincount(key, weight, minlength=slots * width).reshape(slots, width)

        out[0, :, i] = by_bin(g)
        # where all Hessians are 1, they count rows; rows are counted by themselves only where a least number is asked for
        out[1, :, i] = by_bin(None if p.loss == "squared" else h)
        out[2, :, i] = by_bin(None) if p.loss != "squared" and p.least_rows > 1 else out[1, :, i]
    return out


def best_cuts(total: np.ndarray, p: Boosting) -> np.ndarray:
    """gain, bin, and gradient and Hessian left and right, of the best cut for sums (three, ..., bins)."""
    g, h = np.cumsum(total[0], axis=-1), np.cumsum(total[1], axis=-1)
    all_g, all_h = g[..., -1:], h[..., -1:]
    left = g[..., :-1], h[..., :-1]
    right = all_g - left[0], all_h - left[1]

    def score(g, h):
        g = np.abs(g)
        if p.l1:
            g = np.maximum(g - p.l1, 0.0)
        return g * g / (h + (p.l2 + 1e-300))

    gain = score(*left) + score(*right) - score(all_g, all_h)
    fewest = np.minimum(left[1], right[1])
    banned = fewest < p.least_hessian if p.least_hessian > 0 else fewest <= 0
    if p.least_rows > 1:
        n = np.cumsum(total[2], axis=-1)
        banned |= np.minimum(n[..., :-1], n[..., -1:] - n[..., :-1]) < p.least_rows
    gain[banned] = -np.inf
    at = gain.argmax(-1)[..., None]
    picked = [np.take_along_axis(x, at, -1)[..., 0] for x in (gain, left[0], left[1], right[0], right[1])]
    return np.stack([picked[0], at[..., 0].astype(float), *picked[1:]], axis=-1)


def chosen(cuts: np.ndarray, columns: np.ndarray) -> list[Cut | None]:
    """The best cut of each slot over its columns (slots, columns, 6), the first of equal ones; None without a gain."""
    best = cuts[..., 0].argmax(1)
    out = []
    for slot, c in zip(cuts, best.tolist(), strict=True):
        gain, at, *side = slot[c].tolist()
        out.append(Cut(gain, int(columns[c]), int(at), (side[0], side[1]), (side[2], side[3])) if gain > LEAST_GAIN else None)
    return out


# ---------------------------------------------------------------- growth, whoever sums


def grow(p: Boosting, find: Callable[[Tree, list[int]], list[Cut | None]]) -> Tree:
    """A tree; ``find`` gives the best cuts of nodes, for rows as the tree sends them."""
    tree, found = Tree(), {}
    if p.depth is not None:
        level = [0]
        for _ in range(p.depth):
            cuts = find(tree, level) if level else []
            below = []
            for node, cut in zip(level, cuts, strict=True):
                if cut is not None:
                    found[node] = cut
                    tree.split(node, cut)
                    below += [tree.left[node], tree.left[node] + 1]
            level = below
        return _valued(tree, found, p)
    # best leaf first: open leaves that may be split next get children, whose cuts are found together
    found = dict(enumerate(find(tree, [0])))
    final, heap = {}, []

    def offer(node: int) -> None:
        if found[node] is not None:
            heapq.heappush(heap, (-found[node].gain, node))

    offer(0)
    while heap and len(final) + 1 < p.leaves:
        node = heap[0][1]
        if tree.left[node] < 0:
            # every leaf that could be among the next ones to be split
            ahead = [n for _, n in heapq.nsmallest(p.leaves - 1 - len(final), heap) if tree.left[n] < 0]
            for n in ahead:
                tree.split(n, found[n])
            children = [c for n in ahead for c in (tree.left[n], tree.left[n] + 1)]
            found |= zip(children, find(tree, children), strict=True)
        heapq.heappop(heap)
        final[node] = found[node]
        offer(tree.left[node])
        offer(tree.left[node] + 1)
    return _valued(tree, final, p)


def _valued(tree: Tree, final: dict[int, Cut], p: Boosting) -> Tree:
    """The tree of the ``final`` cuts alone, numbered anew, with the values of its leaves."""
    out, todo = Tree(), [(0, 0)]
    while todo:
        old, new = todo.pop()
        if old not in final:
            continue
        cut = final[old]
        out.split(new, cut)
        for k, (g, h) in enumerate((cut.left, cut.right)):
            out.value[out.left[new] + k] = float(-soft(g, p.l1) / (h + p.l2 + 1e-300) * p.rate)
            todo.append((tree.left[old] + k, out.left[new] + k))
    return out


def better(history: list[float], p: Boosting) -> bool:
    """Whether any of the last ``patience`` losses is better than the one before them."""
    if p.patience is None or len(history) <= p.patience:
        return True
    return min(history[-p.patience :]) < history[-p.patience - 1] - p.tolerance


class Part:
    """Training rows of one task: bins (a row for each column), labels, ids and margins."""

    def __init__(self, bins: np.ndarray, y: np.ndarray, ids: np.ndarray, margin: np.ndarray, p: Boosting, stops: bool):
        self.bins, self.y, self.ids, self.margin, self.p = bins, y, ids, margin, p
        self.held = shares(ids, p.seed, -1) < p.hold_out if stops else np.zeros(len(y), bool)

    def begin(self, number: int, columns: np.ndarray) -> None:
        """What a tree sees: rows, columns and gradients."""
        seen = np.flatnonzero(~self.held & (shares(self.ids, self.p.seed, number) < self.p.rows))
        self.g, self.h = gradients(self.p.loss, self.y[seen], self.margin[seen])
        self.rows, self.own = self.bins[:, seen], self.bins[np.ix_(columns, seen)]
        self.node = np.zeros(len(seen), np.int64)

    def sums(self, tree: Tree, nodes: list[int]) -> np.ndarray:
        self.node = route(tree, self.rows, self.node)
        slot_of = np.full(len(tree.left), -1)
        slot_of[nodes] = np.arange(len(nodes))
        return sums(self.own, slot_of[self.node], self.g, self.h, len(nodes), self.p)

    def add(self, tree: Tree) -> None:
        self.margin = self.margin + np.array(tree.value)[route(tree, self.bins, np.zeros(len(self.y), np.int64))]

    def held_loss(self) -> tuple[float, int]:
        return float(losses(self.p.loss, self.y[self.held], self.margin[self.held]).sum()), int(self.held.sum())


# ---------------------------------------------------------------- frames


def edges(rows: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Upper ends of each column's bins but the last: values at even shares of the rows, from one aggregate."""
    at = [(i + 1) / bins for i in range(bins - 1)]
    found = rows.agg(*(F.percentile_approx(F.col(f).cast("double"), at, 10 * bins).alias(f"c{i}") for i, f in enumerate(features))).first()
    return [np.unique(np.array(x if x is not None else [], float)) for x in found]


def binned(rows: DataFrame, features: list[str], cuts: list[np.ndarray], *keep: Column) -> DataFrame:
    """``keep`` and bins (a byte for each feature): the number of a column's edges that a value exceeds."""

    @F.pandas_udf("binary")
    def place(values: pd.Series) -> pd.Series:
        x = np.stack(values.to_numpy()) if len(values) else np.zeros((0, len(cuts)))
        out = np.stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(cuts)], axis=1).astype(np.uint8)
        return pd.Series([r.tobytes() for r in out])

    return rows.select(*keep, place(F.array(*(F.col(f).cast("double") for f in features))).alias("bins"))


def _arrays(batch: pa.RecordBatch, features: int) -> tuple[np.ndarray, ...]:
    flat = np.frombuffer(b"".join(batch["bins"].to_pylist()), np.uint8).reshape(-1, features)
    return np.ascontiguousarray(flat.T), np.asarray(batch["y"]), np.asarray(batch["id"])


@dataclass
class Model:
    """Fitted trees and the margin before the first of them."""

    features: list[str]
    start: float
    loss: str
    trees: list[Tree]

    def margin(self) -> Column:
        """The sum of all trees for a row that has all features."""
        tables = [tuple(map(np.array, (t.feature, t.threshold, t.left, t.value))) for t in self.trees]
        start = self.start

        @F.pandas_udf("double")
        def total(values: pd.Series) -> pd.Series:
            if not len(values):
                return pd.Series([], dtype=float)
            x = np.stack(values.to_numpy())
            out = np.full(len(x), start)
            for feature, cut, left, value in tables:
                node = np.zeros(len(x), np.int64)
                moving = np.flatnonzero(left[node] >= 0)
                while len(moving):
                    at = node[moving]
                    node[moving] = left[at] + (x[moving, feature[at]] > cut[at])
                    moving = moving[left[node[moving]] >= 0]
                out += value[node]
            return pd.Series(out)

        return total(F.array(*(F.col(f).cast("double") for f in self.features)))

    def predict(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` with the expected label: a probability for the logistic loss."""
        return rows.withColumn(name, 1 / (1 + F.exp(-self.margin())) if self.loss == "logistic" else self.margin())

    def table(self, spark: SparkSession) -> DataFrame:
        """The model as rows, a row for each node; tree -1 has the margin before the first tree, and the loss as its feature."""
        rows = [(-1, 0, self.loss, 0, 0.0, -1, float(self.start))]
        for i, t in enumerate(self.trees):
            rows += [(i, n, self.features[t.feature[n]] if t.left[n] >= 0 else None, t.bin[n], t.threshold[n], t.left[n], t.value[n]) for n in range(len(t.left))]
        return spark.createDataFrame(rows, "tree int, node int, feature string, bin int, threshold double, left int, value double")


def read_model(table: DataFrame, features: list[str]) -> Model:
    """The model that :meth:`Model.table` wrote, for columns in the order of ``features``."""
    place = {f: i for i, f in enumerate(features)}
    trees: dict[int, list] = {}
    for r in table.orderBy("tree", "node").collect():  # as many rows as the model has nodes
        trees.setdefault(r["tree"], []).append(r)
    (head,) = trees.pop(-1)
    return Model(features, head["value"], head["feature"], [Tree([place.get(r["feature"], 0) for r in x], *([r[c] for r in x] for c in ("bin", "left", "value", "threshold"))) for x in trees.values()])


def _tree_of(rows: list) -> Tree:
    return Tree([r["feature"] for r in rows], [r["bin"] for r in rows], [r["left"] for r in rows], [r["value"] for r in rows])


def fit(rows: DataFrame, features: list[str], label: str, key: str, p: Boosting, part_rows: int = PART_ROWS, cuts: list[np.ndarray] | None = None) -> Model:
    """Boosted trees for ``label`` (0 and 1 for the logistic loss).

    Rows with a null feature or label are left out. ``key`` tells rows apart;
    sampling follows it alone. Without rows, the model is 0 and has no trees.
    """
    ready = rows.na.drop(subset=[*features, label]).select(F.xxhash64(F.lit(p.seed), key).alias("id"), F.col(label).cast("double").alias("y"), *features)
    n, mean = ready.agg(F.count("*"), F.avg("y")).first()
    if not n:
        return Model(features, 0.0, p.loss, [])
    cuts = edges(ready, features, p.bins) if cuts is None else cuts
    start = mean if p.loss == "squared" else float(np.log(min(max(mean, 1e-6), 1 - 1e-6) / (1 - min(max(mean, 1e-6), 1 - 1e-6))))
    stops = p.patience is not None and n > p.stop_from
    table = binned(ready, features, cuts, F.col("id"), F.col("y"))
    take = _in_one_task if n <= part_rows else _by_jobs
    trees = take(table, len(features), start, p, stops, -(-n // part_rows))
    for t in trees:
        t.threshold = [float(cuts[f][b]) if left >= 0 else 0.0 for f, b, left in zip(t.feature, t.bin, t.left, strict=True)]
    return Model(features, start, p.loss, trees)


def _in_one_task(table: DataFrame, features: int, start: float, p: Boosting, stops: bool, parts: int) -> list[Tree]:
    def run(batches: Iterator[pa.RecordBatch]):
        read = [_arrays(b, features) for b in batches if b.num_rows]
        if not read:
            return
        bins, y, ids = (np.concatenate(x, axis=-1) for x in zip(*read, strict=True))
        part = Part(bins, y, ids, np.full(len(y), start), p, stops)
        history: list[float] = []
        for number in range(p.trees):
            columns = columns_of(p, features, number)
            part.begin(number, columns)
            tree = grow(p, lambda t, nodes, columns=columns: chosen(best_cuts(part.sums(t, nodes), p), columns))
            part.add(tree)
            many = len(tree.left)
            yield pa.record_batch([pa.array([number] * many, pa.int32()), pa.array(range(many), pa.int32()), *(pa.array(x, pa.int32()) for x in (tree.feature, tree.bin, tree.left)), pa.array(tree.value, pa.float64())], names=["tree", "node", "feature", "bin", "left", "value"])
            if stops:
                total, held = part.held_loss()
                history.append(total / max(1, held))
                if not better(history, p):
                    return

    rows = table.coalesce(1).mapInArrow(run, "tree int, node int, feature int, bin int, left int, value double").collect()
    trees: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["tree"], r["node"])):
        trees.setdefault(r["tree"], []).append(r)
    return [_tree_of(x) for x in trees.values()]


def _by_jobs(table: DataFrame, features: int, start: float, p: Boosting, stops: bool, parts: int) -> list[Tree]:
    held = settled(table.withColumn("margin", F.lit(start)).repartition(parts), "boosting-rows")
    trees, written, history = [], 0, []

    def part_of(batch: pa.RecordBatch, since: list[Tree]) -> Part:
        bins, y, ids = _arrays(batch, features)
        part = Part(bins, y, ids, np.asarray(batch["margin"]), p, stops)
        for t in since:
            part.add(t)
        return part

    def find(number: int, columns: np.ndarray, since: list[Tree], tree: Tree, nodes: list[int]) -> list[Cut | None]:
        def add_up(batches):
            total = None
            for batch in batches:
                if batch.num_rows:
                    part = part_of(batch, since)
                    part.begin(number, columns)
                    own = part.sums(tree, nodes)
                    total = own if total is None else total + own
            if total is not None:
                places = [(s, c) for s in range(len(nodes)) for c in range(len(columns))]
                yield pa.record_batch([pa.array([s for s, _ in places], pa.int32()), pa.array([c for _, c in places], pa.int32()), pa.array([total[:, s, c].tobytes() for s, c in places], pa.binary())], names=["slot", "place", "sums"])

        def cut(key, group):
            total = sum(np.frombuffer(x, np.float64).reshape(3, p.bins) for x in group["sums"].to_pylist())
            return pa.table({"slot": pa.array([key[0].as_py()], pa.int32()), "place": pa.array([key[1].as_py()], pa.int32()), "cut": pa.array([best_cuts(total, p).tolist()], pa.list_(pa.float64()))})

        parts = held.mapInArrow(add_up, "slot int, place int, sums binary").groupBy("slot", "place").applyInArrow(cut, "slot int, place int, cut array<double>").collect()
        table = np.full((len(nodes), len(columns), 6), -np.inf)
        for r in parts:
            table[r["slot"], r["place"]] = r["cut"]
        return chosen(table, columns)

    def margins(since: list[Tree]):
        def run(batches):
            for batch in batches:
                part = part_of(batch, since)
                yield pa.record_batch([batch["id"], batch["y"], batch["bins"], pa.array(part.margin, pa.float64())], names=["id", "y", "bins", "margin"])

        return run

    def loss(since: list[Tree]) -> float:
        def run(batches):
            for batch in batches:
                total, n = part_of(batch, since).held_loss()
                yield pa.record_batch([pa.array([total]), pa.array([n], pa.int64())], names=["total", "n"])

        total, n = held.mapInArrow(run, "total double, n long").agg(F.sum("total"), F.sum("n")).first()
        return total / max(1, n)

    for number in range(p.trees):
        since, columns = trees[written:], columns_of(p, features, number)
        trees.append(grow(p, lambda t, nodes, since=since, columns=columns, number=number: find(number, columns, since, t, nodes)))
        if stops:
            history.append(loss(trees[written:]))
            if not better(history, p):
                break
        if len(trees) - written >= WRITTEN_TREES:
            held = settled(held.mapInArrow(margins(trees[written:]), "id long, y double, bins binary, margin double"), "boosting-rows")
            written = len(trees)
    return trees
