"""Second-order gradient boosting on histograms, for rows that lie over many executors.

Features are binned at quantiles of a mergeable sketch. Binned rows are packed in blocks, one byte or two for a
feature, and written once. For each level of a tree every task sums up gradients and hessians of its blocks by
node, feature and bin; the sums of all tasks meet in a tree reduction, whose size depends on the settings and never on
the number of rows, and the best split of each node follows from them: its gain is regularised by L1 and L2 penalties,
and either child must hold a least sum of hessians. Rows without a value go to the side that gains more.

Margins of a block follow from its stored margin and the trees since then. A Python worker remembers the last ones
it has seen, as far as ``MEMORY`` goes; one that has not takes the trees again, so a lost executor costs time only.
Every ``REFRESH`` trees the blocks are written anew with their margins.
"""

from __future__ import annotations

import json
import math
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored

#: Rows of a block, bytes of margins that a worker remembers, trees between two rewrites of the margins, least gain of a split.
BLOCK_ROWS, MEMORY, REFRESH, LEAST_GAIN = 16_384, 64 << 20, 50, 1e-6
_BLOCK = "block string, n int, bins binary, label binary, margin binary"


@dataclass(frozen=True)
class Settings:
    """Rounds, learning rate, depth, shares of rows and columns of a tree, least sum of hessians of a leaf, penalties, whether classes are weighted, bins, seed."""

    rounds: int
    rate: float
    depth: int
    rows: float = 0.8
    columns: float = 0.8
    leaf: float = 1.0
    l1: float = 0.0
    l2: float = 1.0
    weighted: bool = False
    bins: int = 256
    seed: int = 42


@dataclass
class Tree:
    """A tree as a heap: the children of node i are 2i + 1 and 2i + 2. ``feature`` is -1 at a leaf; rows with bin <= ``bin`` go left, those without a value by ``default``."""

    feature: np.ndarray
    bin: np.ndarray
    default: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n, bool), np.zeros(n), np.zeros(n))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row ends in; bin 0 holds rows without a value."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(int(math.log2(len(self.feature) + 1)) - 1):
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                break
            b = bins[rows, np.maximum(f, 0)]
            left = np.where(b == 0, self.default[at], b <= self.bin[at])
            at = np.where(inner, 2 * at + 2 - left, at)
        return at


def shrunk(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0)


def best_splits(sums: np.ndarray, columns: np.ndarray, s: Settings) -> list[tuple | None]:
    """For each node the best (gain, feature, bin, default, (g, h) left, (g, h) right) of sums (node, column, bin, 2), or None.

    Of equal gains the first column, then the least bin, then default right wins.
    """
    total = sums.sum(2)[:, :1]
    g, h = total[:, 0, 0], total[:, 0, 1]
    score = lambda g, h: shrunk(g, s.l1) ** 2 / (h + s.l2)
    with np.errstate(invalid="ignore", divide="ignore"):
        below = np.cumsum(sums[:, :, 1:], 2)
        sides = np.stack([below, below + sums[:, :, :1]], 3)  # rows without a value right, left
        lg, lh = sides[..., 0], sides[..., 1]
        rg, rh = g[:, None, None, None] - lg, h[:, None, None, None] - lh
        gain = score(lg, lh) + score(rg, rh) - score(g, h)[:, None, None, None]
        gain[(lh < s.leaf) | (rh < s.leaf) | ~np.isfinite(gain)] = -np.inf
    out: list[tuple | None] = []
    for k in range(len(sums)):
        at = int(np.argmax(gain[k]))
        c, b, d = np.unravel_index(at, gain[k].shape)
        best = gain[k, c, b, d]
        out.append((float(best), int(columns[c]), int(b) + 1, bool(d), (float(lg[k, c, b, d]), float(lh[k, c, b, d])), (float(rg[k, c, b, d]), float(rh[k, c, b, d]))) if best > LEAST_GAIN else None)
    return out


@dataclass
class Booster:
    """Cuts of the features, the trees, the start value; ``kind`` is logistic or squared."""

    features: list[str]
    cuts: list[list[float]]
    kind: str
    start: float
    trees: list[Tree] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Bins from 1 of a table of values, 0 for what is missing. A value equal to a cut lies below it."""
        wide = max(map(len, self.cuts)) + 2 > 256
        out = np.zeros(x.shape, np.uint16 if wide else np.uint8)
        for j, cuts in enumerate(self.cuts):
            there = ~np.isnan(x[:, j])
            out[there, j] = np.searchsorted(cuts, x[there, j], "left") + 1
        return out

    def margins(self, x: np.ndarray) -> np.ndarray:
        bins, out = self.binned(x), np.full(len(x), self.start)
        for t in self.trees:
            out += t.value[t.nodes(bins)]
        return out

    def importance(self) -> dict[str, float]:
        """Mean gain of a feature's splits, as a share of all features'."""
        gains, counts = np.zeros(len(self.features)), np.zeros(len(self.features))
        for t in self.trees:
            inner = t.feature >= 0
            np.add.at(gains, t.feature[inner], t.gain[inner])
            np.add.at(counts, t.feature[inner], 1)
        mean = np.divide(gains, counts, out=np.zeros_like(gains), where=counts > 0)
        return dict(zip(self.features, (mean / mean.sum() if mean.sum() else mean).tolist()))

    def to_json(self) -> str:
        trees = [{k: v.tolist() for k, v in asdict(t).items()} for t in self.trees]
        return json.dumps({"features": self.features, "cuts": self.cuts, "kind": self.kind, "start": self.start, "trees": trees})

    @classmethod
    def from_json(cls, text: str) -> Booster:
        d = json.loads(text)
        kinds = {"feature": np.int32, "bin": np.int32, "default": bool, "value": float, "gain": float}
        d["trees"] = [Tree(**{k: np.array(v, kinds[k]) for k, v in t.items()}) for t in d["trees"]]
        return cls(**d)


def quantile_cuts(rows: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Ascending distinct cuts of each feature from one pass of sketches; the greatest value is the last cut."""
    most = bins - 3  # beside the least value, the bin above all cuts and that of missing values
    shares = [i / most for i in range(1, most + 1)]
    value = lambda f: F.when(~F.isnan(f), F.col(f).cast("double"))
    found = rows.agg(*[F.percentile_approx(value(f), shares, F.lit(max(10_000, 40 * bins))).alias(f"c{i}") for i, f in enumerate(features)], *[F.min(value(f)).alias(f"m{i}") for i, f in enumerate(features)]).first()
    return [sorted({*found[f"c{i}"], found[f"m{i}"]}) if found[f"c{i}"] else [] for i in range(len(features))]


def packed(rows: DataFrame, label: str, model: Booster) -> DataFrame:
    """Blocks of binned rows with labels and start margins."""
    features, start = model.features, model.start

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(i, BLOCK_ROWS)
                x = np.column_stack([part.column(j).to_numpy(zero_copy_only=False).astype(float) for j in range(len(features))])
                y = part.column(len(features)).to_numpy(zero_copy_only=False).astype(float)
                values = [uuid.uuid4().hex, len(y), model.binned(x).tobytes(), y.tobytes(), np.full(len(y), start).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["block", "n", "bins", "label", "margin"])

    return rows.select(*[F.col(f).cast("double") for f in features], F.col(label).cast("double")).mapInArrow(run, _BLOCK)


#: Margins by (fit, block): (number of trees, margins). One for each Python worker.
_SEEN: OrderedDict[tuple[str, str], tuple[int, np.ndarray]] = OrderedDict()


def _margin(fit: str, block: str, stored_at: int, stored_margin: np.ndarray, trees: list[Tree], bins: np.ndarray) -> np.ndarray:
    """The block's margins after all ``trees``, of which those since ``stored_at`` are given."""
    done, margin = _SEEN.pop((fit, block), (-1, stored_margin))
    if done < stored_at:
        done, margin = stored_at, stored_margin
    for t in trees[done - stored_at :]:
        margin = margin + t.value[t.nodes(bins)]
    _SEEN[fit, block] = (stored_at + len(trees), margin)
    while len(_SEEN) > 1 and sum(m.nbytes for _, m in _SEEN.values()) > MEMORY:
        _SEEN.popitem(last=False)
    return margin


@dataclass
class _Pass:
    """What a task needs to sum up one level of a tree."""

    fit: str
    number: int
    stored_at: int
    trees: list[Tree]
    tree: Tree
    frontier: list[int]
    columns: np.ndarray
    size: int
    kind: str
    positive: float
    settings: Settings
    width: int

    def sums(self, blocks: Iterator[tuple]) -> Iterator[np.ndarray]:
        out = np.zeros((len(self.frontier), len(self.columns), self.size, 2))
        place = np.full(len(self.tree.feature), -1)
        place[self.frontier] = np.arange(len(self.frontier))
        for block, n, bins, label, margin in blocks:
            bins = np.frombuffer(bins, np.uint16 if self.width == 2 else np.uint8).reshape(n, -1)
            y = np.frombuffer(label)
            m = _margin(self.fit, block, self.stored_at, np.frombuffer(margin), self.trees, bins)
            if self.kind == "logistic":
                p = 1 / (1 + np.exp(-m))
                w = np.where(y == 1, self.positive, 1.0)
                g, h = (p - y) * w, np.maximum(p * (1 - p), 1e-16) * w
            else:
                g, h = m - y, np.ones(n)
            at = place[self.tree.nodes(bins)]
            take = at >= 0
            if self.settings.rows < 1:  # the same rows at every level of a tree, whichever task asks
                take &= np.random.default_rng([self.settings.seed, self.number, int(block[:15], 16)]).random(n) < self.settings.rows
            if not take.any():
                continue
            at, g, h = at[take] * self.size, g[take], h[take]
            for j, c in enumerate(self.columns):
                index = at + bins[take, c]
                for k, v in enumerate((g, h)):
                    out[:, j, :, k] += np.bincount(index, v, out.shape[0] * self.size).reshape(out.shape[0], self.size)
        yield out


def _blocks(table: DataFrame, count: int) -> RDD:
    """The blocks of a fit over ``count`` rows, in tasks that have work for more than their own start."""
    return table.rdd.coalesce(max(1, count // BLOCK_ROWS)).map(tuple).persist(StorageLevel.MEMORY_AND_DISK)


def fit(rows: DataFrame, features: list[str], label: str, settings: Settings, kind: str = "logistic", positive: float = 1.0) -> Booster:
    """Boosted trees for a label of 0 and 1 (logistic loss, positives weighing ``positive``) or for a number (squared loss).

    Rows whose label is null or NaN take no part; null and NaN features are missing values. Without rows an error. The start
    is a probability of one half, or the mean label. Trees see shares of rows and columns drawn from the seed.
    """
    rows = rows.where(F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double")))
    start = rows.agg(F.count(label).alias("n"), F.avg(F.col(label).cast("double")).alias("mean")).first()
    if not start["n"]:
        raise ValueError("no rows to learn from")
    model = Booster(list(features), quantile_cuts(rows, features, settings.bins), kind, 0.0 if kind == "logistic" else float(start["mean"]))
    size, width, name = max(map(len, model.cuts)) + 2, 2 if max(map(len, model.cuts)) + 2 > 256 else 1, uuid.uuid4().hex
    table = stored(packed(rows, label, model), "boosting")
    blocks, stored_at = _blocks(table, start["n"]), 0
    for number in range(settings.rounds):
        if number - stored_at >= REFRESH:
            blocks.unpersist()
            table = stored(_refreshed(table, model.trees[stored_at:], width), "boosting")
            blocks, stored_at = _blocks(table, start["n"]), number
        rng = np.random.default_rng([settings.seed, number])
        count = max(1, int(settings.columns * len(features)))
        columns = np.sort(rng.permutation(len(features))[:count])
        tree, frontier = Tree.empty(settings.depth), [0]
        for level in range(settings.depth):
            step = _Pass(name, number, stored_at, model.trees[stored_at:], tree, frontier, columns, size, kind, positive, settings, width)
            sums = blocks.mapPartitions(step.sums).treeReduce(np.add)
            following = []
            for node, (found, own) in zip(frontier, zip(best_splits(sums, columns, settings), sums[:, 0].sum(1))):
                leaf = lambda g, h: float(-shrunk(np.float64(g), settings.l1) / (h + settings.l2) * settings.rate) if h + settings.l2 else 0.0
                if level == 0:
                    tree.value[0] = leaf(*own)
                if found is None:
                    continue
                tree.gain[node], tree.feature[node], tree.bin[node], tree.default[node] = found[:4]
                for child, sums_of in zip((2 * node + 1, 2 * node + 2), found[4:]):
                    tree.value[child] = leaf(*sums_of)
                    following.append(child)
            frontier = following
            if not frontier:
                break
        model.trees.append(tree)
    blocks.unpersist()
    return model


def _refreshed(table: DataFrame, trees: list[Tree], width: int) -> DataFrame:
    """The blocks with margins that include ``trees``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = []
            for n, bins, margin in zip(*(batch.column(c).to_pylist() for c in ("n", "bins", "margin"))):
                bins, m = np.frombuffer(bins, np.uint16 if width == 2 else np.uint8).reshape(n, -1), np.frombuffer(margin)
                for t in trees:
                    m = m + t.value[t.nodes(bins)]
                margins.append(m.tobytes())
            yield batch.set_column(4, "margin", pa.array(margins, pa.binary()))

    return table.mapInArrow(run, _BLOCK)


def with_margin(model: Booster, df: DataFrame, name: str = "margin") -> DataFrame:
    """Rows with the sum of the trees' values and the start."""

    @F.pandas_udf("double")
    def margin(*columns: pd.Series) -> pd.Series:
        return pd.Series(model.margins(np.column_stack([c.to_numpy(float, na_value=np.nan) for c in columns])))

    return df.withColumn(name, margin(*[F.col(f).cast("double") for f in model.features]))
