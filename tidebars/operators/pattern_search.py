"""Exact search for similar windows by block products that skip what cannot matter.

Candidates are sorted by series and time, so neighbouring windows, which overlap, lie close together: a ball of
neighbours is known by its centre and its greatest angle from it. The cosine of an evaluation window with any
window of a ball is at most the cosine of the angle to the centre less that greatest angle. Every task takes the
balls in order of that bound for each evaluation, as matrix products of many evaluations at once, and stops where no
ball left can reach the k-th best found so far. Only its best k rows for each evaluation leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

#: Windows of a ball; evaluation rows and bytes that are broadcast at once; what is equal to so many places is a tie.
BALL, EVALS_AT_ONCE, EVAL_BYTES, PLACES = 128, 3_000, 64 << 20, 9
_SLACK = 10.0**-PLACES


class Best:
    """The k best candidates of each evaluation: cosine, similarity (the cosine to ``PLACES``), time and outcomes. Higher similarity first, then earlier time."""

    def __init__(self, symbols: list, cutoffs: np.ndarray, vectors: np.ndarray, k: int, outcomes: int):
        self.units, self.cutoffs, self.k = vectors / np.linalg.norm(vectors, axis=1, keepdims=True), cutoffs, k
        self.rows_of: dict = {}
        for i, s in enumerate(symbols):
            self.rows_of.setdefault(s, []).append(i)
        n = len(symbols)
        self.similarity, self.time = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.cosine = np.full((n, k), -np.inf)
        self.outcomes = np.zeros((n, k, outcomes))
        self.pairs = self.computed = 0

    def see(self, symbol, times: np.ndarray, vectors: np.ndarray, outcomes: np.ndarray) -> None:
        """Candidates of one series, in order of time."""
        at = np.array(self.rows_of.get(symbol, []), np.int64)
        norms = np.linalg.norm(vectors, axis=1)
        there = norms > 0
        if not len(at) or not there.any():
            return
        times, outcomes, units = times[there], outcomes[there], vectors[there] / norms[there, None]
        starts = np.arange(0, len(units), BALL)
        ends = np.append(starts[1:], len(units))
        centres = np.add.reduceat(units, starts, 0)
        length = np.linalg.norm(centres, axis=1, keepdims=True)
        centres = np.where(length > 0, centres / np.where(length > 0, length, 1), units[starts])
        inner = (units * np.repeat(centres, ends - starts, 0)).sum(1)
        spread = np.arccos(np.clip(np.minimum.reduceat(inner, starts), -1, 1))
        angle = np.arccos(np.clip(self.units[at] @ centres.T, -1, 1))
        bound = np.cos(np.clip(angle - spread, 0, np.pi)) + _SLACK
        open_to = times[starts] < self.cutoffs[at][:, None]
        bound[~open_to] = -np.inf
        self.pairs += int((open_to * (ends - starts)).sum())
        order = np.argsort(-bound, 1, kind="stable")
        for turn in range(len(starts)):
            balls = order[:, turn]
            reach = bound[np.arange(len(at)), balls]
            live = np.flatnonzero((reach > -np.inf) & (reach >= self.similarity[at, -1] - _SLACK))
            if not len(live):
                break
            for ball in np.unique(balls[live]):
                self._take(at[live[balls[live] == ball]], times[starts[ball] : ends[ball]], units[starts[ball] : ends[ball]], outcomes[starts[ball] : ends[ball]])

    def _take(self, at: np.ndarray, times: np.ndarray, units: np.ndarray, outcomes: np.ndarray) -> None:
        self.computed += len(at) * len(times)
        cosine = self.units[at] @ units.T
        found = np.round(cosine, PLACES)
        found[times >= self.cutoffs[at][:, None]] = -np.inf
        similarity = np.concatenate([self.similarity[at], found], 1)
        cosine = np.concatenate([self.cosine[at], cosine], 1)
        time = np.concatenate([self.time[at], np.broadcast_to(times, found.shape)], 1)
        order = np.lexsort((time, -similarity), axis=-1)[:, : self.k]
        values = np.concatenate([self.outcomes[at], np.broadcast_to(outcomes, (len(at), *outcomes.shape))], 1)
        self.similarity[at], self.time[at] = np.take_along_axis(similarity, order, 1), np.take_along_axis(time, order, 1)
        self.cosine[at] = np.take_along_axis(cosine, order, 1)
        self.outcomes[at] = np.take_along_axis(values, order[:, :, None], 1)


def _matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _searched(pool: DataFrame, side: pa.Table, k: int, outcomes: list[str]) -> DataFrame:
    """(place, similarity, _order, _time, outcomes) of one block of evaluations, ``_order`` being what ties are told by; place -1 holds the pairs there are and those computed."""
    n = side.num_rows
    sent = pool.sparkSession.sparkContext.broadcast((side.column("symbol").to_pylist(), side.column("_cutoff").cast(pa.int64()).to_numpy(), _matrix(side.column("vector"), n)))
    names = ["place", "similarity", "_order", "_time", *outcomes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(*sent.value, k, len(outcomes))
        for batch in batches:
            symbols, times = batch.column(0).to_pylist(), batch.column(1).cast(pa.int64()).to_numpy()
            vectors = _matrix(batch.column(2), batch.num_rows)
            values = np.array([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(3, batch.num_columns)]).reshape(len(outcomes), -1).T
            cuts = [0, *[i for i in range(1, len(symbols)) if symbols[i] != symbols[i - 1]], len(symbols)]
            for a, b in zip(cuts, cuts[1:]):
                best.see(symbols[a], times[a:b], vectors[a:b], values[a:b])
        place, slot = np.nonzero(best.similarity > -np.inf)
        kept = best.outcomes[place, slot]
        columns = [np.append(place, -1), np.append(best.cosine[place, slot], best.pairs), np.append(best.similarity[place, slot], 0.0), np.append(best.time[place, slot], best.computed), *[np.append(kept[:, j], 0.0) for j in range(len(outcomes))]]
        # NaN stands for a null outcome
        yield pa.RecordBatch.from_arrays([pa.array(c, t, from_pandas=True) for c, t in zip(columns, [pa.int32(), pa.float64(), pa.float64(), pa.int64(), *[pa.float64()] * len(outcomes)])], names)

    found = pool.mapInArrow(run, ", ".join(["place int", "similarity double", "_order double", "_time long", *[f"`{c}` double" for c in outcomes]]))
    keys = pa.Table.from_arrays([pa.array(range(n), pa.int32()), side.column("symbol"), side.column("_at")], ["place", "eval_symbol", "eval_at"])
    return found.join(F.broadcast(pool.sparkSession.createDataFrame(keys)), "place", "left")  # at most ``EVALS_AT_ONCE`` rows


def search_windows(windows: DataFrame, evals: DataFrame, k: int, apart: str, outcomes: list[str], time: str = "window_end_ts") -> tuple[DataFrame, DataFrame]:
    """Of each evaluation window the k most similar windows of its series that end at least ``apart`` before it, strictly.

    Two tables: (eval_symbol, eval_at, rank, similarity, outcomes) of evaluations that have k such windows; and
    (pairs, computed), how many pairs there were and how many were computed. ``windows`` and ``evals`` hold symbol, ``time``
    and vector, of one length. Windows without direction take no part. Ties, to nine places, go to the earlier window;
    ``similarity`` itself is not rounded.
    Evaluations are broadcast in blocks of bounded rows and bytes, each with a pass over the windows, which are written once.
    """
    pool = windows.select("symbol", time, "vector", *outcomes)
    pool = stored(pool.repartitionByRange("symbol", time).sortWithinPartitions("symbol", time), "windows")
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    named = evals.where(squares > 0).select("symbol", F.col(time).alias("_at"), (F.col(time) - F.expr(apart)).alias("_cutoff"), "vector")
    named = stored(named, "evaluations")
    size = named.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(8 * F.size("vector") + 256), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // EVALS_AT_ONCE), -(-size["bytes"] // EVAL_BYTES))
    found = None
    for b in range(blocks):
        side = (named if blocks == 1 else named.where(F.pmod(F.xxhash64("symbol", "_at"), F.lit(blocks)) == b)).toArrow()
        if side.num_rows or found is None:
            part = _searched(pool, side, k, outcomes) if side.num_rows else None
            found = part if found is None else found.unionByName(part)
    if found is None:  # no evaluation at all: columns of an empty search
        spark = windows.sparkSession
        kind = dict(windows.dtypes)
        rows = spark.createDataFrame([], f"eval_symbol {kind['symbol']}, eval_at {kind[time]}, rank int, similarity double" + "".join(f", `{c}` double" for c in outcomes))
        return rows, spark.createDataFrame([(0, 0)], "pairs long, computed long")
    found = stored(found, "search")
    order = Window.partitionBy("eval_symbol", "eval_at").orderBy(F.desc("_order"), F.asc("_time"))
    best = found.where("place >= 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    whole = Window.partitionBy("eval_symbol", "eval_at")
    best = best.withColumn("_n", F.count(F.lit(1)).over(whole)).where(F.col("_n") == k).select("eval_symbol", "eval_at", "rank", "similarity", *outcomes)
    return best, found.where("place < 0").agg(F.sum("similarity").cast("long").alias("pairs"), F.sum("_time").alias("computed"))
