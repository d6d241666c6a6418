"""Boosted trees with penalised, leaf-wise growth, fitted by a loop of DataFrame aggregates.

Features are cut into bins at their approximate quantiles once. A round sums gradients and their weights by (node,
feature, bin), for all nodes of a level at once: a task adds its rows up in one array, so that a row is not taken apart
into one row for each feature, and the tasks' sums are added by an aggregate. Running sums over the bins of a node and
feature give the gain of every split. A level is one job with one shuffle, of the tasks' sums, and sends one row per
node and feature, the best split there, to the driver. A node's split does not
depend on the order in which others are split, so best-first growth takes the splits of greatest gain from the tree grown
to full depth. What the driver holds is bounded by the nodes and features of one tree, a task's array by ``CELLS``;
predictions stay with the rows, written to the shared folder after each round. A table of up to ``SMALL`` bytes of bins is
brought to the driver after the first write and goes through the same sums and gains there, without a job for each level.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomry.session import drop_dir, fresh_dir

CELLS = 2_000_000  # sums a task holds at once; a level of more nodes is summed in several passes
ROWS = 32_768  # rows a task adds up at a time
SMALL = 32 << 20  # bytes of bins up to which a table is fitted in the driver


@dataclass(frozen=True)
class Settings:
    """The settings of the reference model. ``alpha`` and ``lam`` penalise leaf values by their absolute
    value and their square, ``gamma`` is the least gain of a split, ``child_weight`` the least weight of a child."""

    rounds: int = 100
    depth: int = 8
    leaves: int = 256
    rate: float = 0.1
    alpha: float = 0.9
    lam: float = 1.0
    gamma: float = 0.1
    child_weight: float = 30.0
    positive_weight: float = 2.0
    base: float = 0.5
    bins: int = 64


@dataclass
class Tree:
    """Nodes by number; the children of n are 2n + 1 (bin at most ``cut``) and 2n + 2. A leaf has feature -1."""

    feature: list[int]
    cut: list[int]
    value: list[float]


@dataclass
class Model:
    inputs: list[str]
    cuts: list[list[float]]  # ascending; a value equal to a cut lies above it
    settings: Settings
    trees: list[Tree] = field(default_factory=list)

    def binned(self, df: DataFrame, out: str = "__bins") -> DataFrame:
        """Adds the bin number of every input as an array; a value that is null or not a number lies in the last bin."""
        used = [i for i, c in enumerate(self.cuts) if c]
        names = {i: f"__bin{i}" for i in used}
        numbers = df.withColumns({f"__in{i}": F.col(f"`{self.inputs[i]}`").cast("double") for i in used})
        if used:
            splits = [[-math.inf, *self.cuts[i], math.inf] for i in used]
            numbers = Bucketizer(splitsArray=splits, inputCols=[f"__in{i}" for i in used], outputCols=list(names.values()), handleInvalid="keep").transform(numbers)
        last = [len(c) + 1 for c in self.cuts]
        bins = F.array(*[F.coalesce(F.col(names[i]).cast("int"), F.lit(last[i])) if i in names else F.lit(0) for i in range(len(self.inputs))])
        return numbers.select(*df.columns, bins.alias(out))

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Every row with the model's prediction."""
        trees = [(_descent(t, self.settings.depth), np.array(t.value)) for t in self.trees]
        matrix, base = _matrix(len(self.inputs)), self.settings.base

        @F.arrow_udf("double")
        def told(bins: pa.Array) -> pa.Array:
            found = matrix(bins)
            total = np.full(len(bins), base)
            for fall, value in trees:
                total += value[fall(found)]
            return pa.array(total)

        return self.binned(df).withColumn(out, told("__bins")).select(*df.columns, out)


def _matrix(inputs: int):
    """Function from an Arrow array of bins to a row of ``inputs`` numbers each."""
    # A slice of a list array shares its values; flatten gives those of the slice.
    return lambda bins: bins.flatten().to_numpy(zero_copy_only=False).reshape(len(bins), inputs)


def _packed(bins: Column, inputs: int, most: int = 1 << 31) -> Column:
    """A row's bins, all below ``most``, as bytes which reach Python as they are: one, two or four for each."""
    matrix, size = _matrix(inputs), 1 if most <= 1 << 8 else 2 if most <= 1 << 16 else 4

    @F.arrow_udf("binary")
    def pack(found: pa.Array) -> pa.Array:
        data = np.ascontiguousarray(matrix(found), f"<u{size}")
        ends = np.arange(len(found) + 1, dtype=np.int32) * (size * inputs)
        return pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(ends), pa.py_buffer(data)])

    return pack(bins)


def _unpacked(inputs: int):
    """Function from an Arrow array of ``_packed`` rows to a row of ``inputs`` numbers each."""
    def unpack(rows):
        if not inputs or not len(rows):
            return np.zeros((len(rows), inputs), np.int32)
        first, second = (int(x) for x in np.frombuffer(rows.buffers()[1], np.int32, 2, 4 * rows.offset))
        return np.frombuffer(rows.buffers()[2], f"<u{(second - first) // inputs}", len(rows) * inputs, first).reshape(len(rows), inputs)

    return unpack


def _descent(tree: Tree, depth: int):
    """Function from rows of bins to the number of the node at which each row comes to rest after ``depth`` steps."""
    feature, cut = np.array(tree.feature), np.array(tree.cut)

    def fall(bins):
        node = np.zeros(len(bins), np.int64)
        if not bins.size:
            return node
        each = np.arange(len(bins))
        for _ in range(depth):
            own = feature[node]
            node = np.where(own >= 0, 2 * node + 1 + (bins[each, np.maximum(own, 0)] > cut[node]), node)
        return node

    return fall


def quantile_cuts(df: DataFrame, inputs: Sequence[str], bins: int) -> list[list[float]]:
    """Ascending cuts of every input near its quantiles, from one aggregate; none above the greatest value is needed."""
    shares = [i / bins for i in range(1, bins)]
    found = df.agg(
        *[F.percentile_approx(F.col(f"`{c}`").cast("double"), shares, 10_000).alias(f"q{i}") for i, c in enumerate(inputs)],
        *[F.min(F.col(f"`{c}`").cast("double")).alias(f"m{i}") for i, c in enumerate(inputs)],
    ).first()
    # A cut at the least value would leave nothing below it.
    return [sorted({x for x in found[f"q{i}"] or [] if x > found[f"m{i}"] and not math.isnan(x)}) for i in range(len(inputs))]


def shrunk(total: Column | float, alpha: float):
    """The sum of gradients less the absolute penalty."""
    if isinstance(total, float):
        return math.copysign(max(abs(total) - alpha, 0.0), total)
    return F.signum(total) * F.greatest(F.abs(total) - F.lit(alpha), F.lit(0.0))


def _adder(tree: Tree, level: int, nodes: Sequence[int], inputs: int, bins: int):
    """Function that adds rows (matrix, y, h, p) to the sums of gradients and weights of ``nodes``: arrays of a line for each
    feature and a cell for each node and bin."""
    fall, least = _descent(tree, level), ROWS
    place = np.full(len(tree.feature), -1)
    place[list(nodes)] = np.arange(len(nodes))
    cells = len(nodes) * bins

    def take(matrix, y, h, p, g_sums, h_sums):
        for n in range(0, len(y), least):
            part = matrix[n : n + least]
            at = place[fall(part)]
            kept = np.flatnonzero(at >= 0)
            first, w, part = at[kept] * bins, h[n : n + least][kept], np.ascontiguousarray(part[kept].T)
            g = w * (p[n : n + least][kept] - y[n : n + least][kept])
            for i in range(inputs):
                cell = first + part[i]
                g_sums[i] += np.bincount(cell, g, cells)
                h_sums[i] += np.bincount(cell, w, cells)

    return take


def _told(numbers, bins: int, g_sums, h_sums):
    """(node, feature, bin, g, h) of the cells that are not empty."""
    feature, cell = np.nonzero((g_sums != 0) | (h_sums != 0))
    return numbers[cell // bins], feature, cell % bins, g_sums[feature, cell], h_sums[feature, cell]


def _sums(rows: DataFrame, tree: Tree, level: int, nodes: Sequence[int], inputs: int, bins: int) -> DataFrame:
    """Sums of gradients and weights by (node, feature, bin) over the rows that rest at ``nodes`` after ``level`` steps."""
    take, read, told, least, numbers = _adder(tree, level, nodes, inputs, bins), _unpacked(inputs), _told, ROWS, np.array(nodes)

    def add(batches):
        g_sums, h_sums = np.zeros((inputs, len(numbers) * bins)), np.zeros((inputs, len(numbers) * bins))

        def added(waiting):
            columns = [np.concatenate([pc.fill_null(b.column(i), 0.0).to_numpy(zero_copy_only=False) for b in waiting]) for i in (1, 2, 3)]
            take(np.concatenate([read(b.column(0)) for b in waiting]), *columns, g_sums, h_sums)

        waiting, n = [], 0
        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            if n >= least:
                added(waiting)
                waiting, n = [], 0
        if n:
            added(waiting)
        columns = told(numbers, bins, g_sums, h_sums)
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
        for i in range(0, len(columns[0]), least):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + least], k) for x, k in zip(columns, kinds)], names=["node", "feature", "bin", "g", "h"])

    parts = rows.select("__bins", "y", "h", "p").mapInArrow(add, "node int, feature int, bin int, g double, h double")
    # The tasks have added up what they hold; dealt by node and feature, all that follows needs no other shuffle.
    return parts.repartition("node", "feature").groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


BEST = {"node": pa.int32(), "feature": pa.int32(), "cut": pa.int32(), "gain": pa.float64(), "gl": pa.float64(), "hl": pa.float64(), "gt": pa.float64(), "ht": pa.float64()}


def _finder(s: Settings):
    """Function from sums (node, feature, bin, g, h) to a line as in ``BEST`` for each node and feature: the best split there,
    its gain -inf where there is none, and the sums of the node."""
    def score(g, h):
        return np.maximum(np.abs(g) - s.alpha, 0.0) ** 2 / (h + s.lam)

    def find(node, feature, at, g, h):
        order = np.lexsort((at, feature, node))
        node, feature, at, g, h = node[order], feature[order], at[order], g[order], h[order]
        first = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (feature[1:] != feature[:-1])]) if len(node) else []
        for x, y in zip(first, [*first[1:], len(node)]):
            gl, hl = np.cumsum(g[x:y]), np.cumsum(h[x:y])
            gr, hr = gl[-1] - gl, hl[-1] - hl
            with np.errstate(all="ignore"):
                gain = np.round(score(gl, hl) + score(gr, hr) - score(gl[-1], hl[-1]), 9)
            gain[~((hl >= s.child_weight) & (hr >= s.child_weight) & (gain > s.gamma))] = -np.inf
            i = int(np.argmax(gain))  # of equal gains the first cut
            yield tuple(v.item() for v in (node[x], feature[x], at[x + i], gain[i], gl[i], hl[i], gl[-1], hl[-1]))

    return find


def _best_splits(histogram: DataFrame, s: Settings) -> list[tuple]:
    """Lines as in ``BEST`` for the sums of some nodes."""
    find, kinds = _finder(s), BEST

    def best(batches):
        parts = [b for b in batches if b.num_rows]
        if parts:
            out = find(*(np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in parts]) for i in range(5)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds.values())], names=list(kinds))

    return [tuple(r) for r in histogram.mapInArrow(best, ", ".join(f"{c} {'int' if k == pa.int32() else 'double'}" for c, k in kinds.items())).collect()]


class _Table:
    """Rows (__bins, y, h, p) that stay in the shared folder."""

    def __init__(self, rows: DataFrame, inputs: int, bins: int, s: Settings, folder: str):
        self.inputs, self.bins, self.s, self.folder, self.round = inputs, bins, s, folder, 0
        self.rows = self._written(rows)

    def _written(self, rows: DataFrame) -> DataFrame:
        spark, path = rows.sparkSession, f"{self.folder}/round={self.round}"
        rows.write.parquet(path)
        drop_dir(spark, f"{self.folder}/round={self.round - 1}")
        return spark.read.schema(rows.schema).parquet(path)

    def best(self, tree: Tree, level: int, nodes: Sequence[int]) -> list[tuple]:
        return _best_splits(_sums(self.rows, tree, level, nodes, self.inputs, self.bins), self.s)

    def total(self) -> tuple[float, float]:
        t = self.rows.agg(F.sum(F.col("h") * (F.col("p") - F.col("y"))).alias("g"), F.sum("h").alias("h")).first()
        return t.g or 0.0, t.h or 0.0

    def move(self, tree: Tree) -> None:
        self.round += 1
        self.rows = self._written(_moved(self.rows, tree, self.s.depth, self.inputs))


class _Held:
    """The same rows in the driver."""

    def __init__(self, rows: DataFrame, inputs: int, bins: int, s: Settings):
        table = rows.select("__bins", "y", "h", "p").toArrow()
        self.inputs, self.bins, self.s, read = inputs, bins, s, _unpacked(inputs)
        self.matrix = np.concatenate([np.zeros((0, inputs), np.uint8), *[read(c) for c in table.column(0).chunks]])
        self.y, self.h, self.p = (pc.fill_null(table.column(i), 0.0).to_numpy().copy() for i in (1, 2, 3))

    def best(self, tree: Tree, level: int, nodes: Sequence[int]) -> list[tuple]:
        g, h = np.zeros((self.inputs, len(nodes) * self.bins)), np.zeros((self.inputs, len(nodes) * self.bins))
        _adder(tree, level, nodes, self.inputs, self.bins)(self.matrix, self.y, self.h, self.p, g, h)
        return list(_finder(self.s)(*_told(np.array(nodes), self.bins, g, h)))

    def total(self) -> tuple[float, float]:
        return float((self.h * (self.p - self.y)).sum()), float(self.h.sum())

    def move(self, tree: Tree) -> None:
        fall, value = _descent(tree, self.s.depth), np.array(tree.value)
        for n in range(0, len(self.p), ROWS):
            self.p[n : n + ROWS] += value[fall(self.matrix[n : n + ROWS])]


def grow(table: _Table | _Held, s: Settings, inputs: int, bins: int) -> Tree:
    """One tree for rows of ``inputs`` bins below ``bins`` each: grown best-first to at most ``leaves`` leaves for the
    gradients h * (p - y) and the weights h."""
    size = (1 << (s.depth + 1)) - 1
    full = Tree([-1] * size, [0] * size, [0.0] * size)
    splits: dict[int, dict] = {}
    sums: dict[int, tuple[float, float]] = {}
    nodes, at_once = [0], max(1, CELLS // max(1, inputs * bins))
    for level in range(s.depth):
        found: dict[int, dict] = {}
        for i in range(0, len(nodes), at_once):
            for n, f, cut, gain, gl, hl, gt, ht in sorted(table.best(full, level, nodes[i : i + at_once])):
                if level == 0:
                    sums.setdefault(n, (gt, ht))
                # Of equal gains the first feature.
                if gain > s.gamma and (n not in found or gain > found[n]["gain"]):
                    found[n] = {"feature": f, "cut": cut, "gain": gain, "left": (gl, hl), "right": (gt - gl, ht - hl)}
        for n, x in found.items():
            full.feature[n], full.cut[n] = x["feature"], x["cut"]
        splits |= found
        nodes = [child for n in sorted(found) for child in (2 * n + 1, 2 * n + 2)]
        if not found:
            break
    if not sums:  # no rows, no inputs or no levels
        sums = {0: table.total()}
    tree, waiting, leaves = Tree([-1] * size, [0] * size, [0.0] * size), [], 1
    if 0 in splits:
        heapq.heappush(waiting, (-splits[0]["gain"], 0))
    while waiting and leaves < s.leaves:
        _, n = heapq.heappop(waiting)
        x = splits[n]
        tree.feature[n], tree.cut[n] = x["feature"], x["cut"]
        leaves += 1
        for child, side in ((2 * n + 1, "left"), (2 * n + 2, "right")):
            sums[child] = x[side]
            if child in splits:
                heapq.heappush(waiting, (-splits[child]["gain"], child))
    for n, (g, h) in sums.items():
        if tree.feature[n] < 0:
            tree.value[n] = -s.rate * shrunk(float(g), s.alpha) / (h + s.lam)
    return tree


def fit(df: DataFrame, label: str, inputs: Sequence[str], weight: str | None = None, settings: Settings = Settings()) -> Model:
    """Squared loss; ``weight`` is a row's multiplicity, and a row of positive label weighs ``positive_weight`` times.

    Rows without a label are left out. A table without rows gives the base value for every row.
    """
    model = Model(list(inputs), quantile_cuts(df, inputs, settings.bins), settings)
    copies = F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)
    y = F.col(f"`{label}`").cast("double")
    bins = max((len(c) + 2 for c in model.cuts), default=1)
    rows = model.binned(df.filter(y.isNotNull())).select(
        _packed(F.col("__bins"), len(inputs), bins).alias("__bins"), y.alias("y"),
        (copies * F.when(y > 0, settings.positive_weight).otherwise(1.0)).alias("h"), F.lit(settings.base).alias("p"),
    )
    table: _Table | _Held = _Table(rows, len(inputs), bins, settings, fresh_dir(df.sparkSession, "trees"))
    if table.rows.count() * max(1, len(inputs)) <= SMALL:
        table = _Held(table.rows, len(inputs), bins, settings)
    for _ in range(settings.rounds):
        tree = grow(table, settings, len(inputs), bins)
        model.trees.append(tree)
        if tree.feature[0] < 0 and tree.value[0] == 0.0:
            break  # every further tree would be the same
        if len(model.trees) < settings.rounds:
            table.move(tree)
    return model


def _moved(rows: DataFrame, tree: Tree, depth: int, inputs: int) -> DataFrame:
    """Rows with the tree's value added to their prediction."""
    fall, read, value = _descent(tree, depth), _unpacked(inputs), np.array(tree.value)

    @F.arrow_udf("double")
    def added(bins: pa.Array) -> pa.Array:
        return pa.array(value[fall(read(bins))])

    return rows.withColumn("p", F.col("p") + added("__bins"))
