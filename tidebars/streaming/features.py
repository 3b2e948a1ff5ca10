"""Features of a stream of ticks: bars that close by timers, and the last closes of each symbol as state.

The state of a symbol is its open bars and the last ``KEPT`` closed ones, however long the stream runs. A timer at
the end of each open bar closes it when the watermark passes; its features come from the closed bars before it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..operators.indicators import MAIN_FEATURES

#: Closed bars that are kept: the longest window, 120 closes, has a return ahead of it where it needs one.
KEPT = 121
_BAR = ["open", "high", "low", "close", "volume", "turnover"]
SCHEMA = "symbol string, ts timestamp, " + ", ".join(f"{c} double" for c in [*_BAR, *MAIN_FEATURES])


def use_rocksdb(spark: SparkSession) -> None:
    """State of any size outside the heap; timers and maps need it. To be set before the query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _ratio(a: float, b: float) -> float | None:
    return a / b if b else None


def last_features(bar: dict, closes: list[float], volumes: list[float]) -> dict:
    """The features of the newest of some bars, from their closes and volumes; None where there are too few. Rules as in ``indicators.main_features``."""
    less = lambda x: None if x is None else x - 1
    change = lambda values, k: less(_ratio(values[-1], values[-1 - k])) if len(values) > k else None
    mean = lambda values, n: math.fsum(values[-n:]) / n if len(values) >= n else None
    returns = [less(_ratio(b, a)) for a, b in zip(closes, closes[1:])]

    def deviation(n: int) -> float | None:
        last = returns[-n:]
        if len(last) < n or None in last:
            return None
        m = math.fsum(last) / n
        return math.sqrt(math.fsum((x - m) ** 2 for x in last) / (n - 1))

    def strength(n: int) -> float | None:
        steps = [b - a for a, b in zip(closes, closes[1:])][-n:]
        if len(steps) < n:
            return None
        gain, loss = math.fsum(max(s, 0.0) for s in steps) / n, math.fsum(max(-s, 0.0) for s in steps) / n
        return 100 - 100 / (1 + gain / loss) if loss else 100.0 if gain else 50.0

    out = {f"return_{k}": change(closes, k) for k in (1, 3, 5, 10)} | {f"ma_{n}": mean(closes, n) for n in (20, 60, 120)}
    out |= {f"ma_distance_{n}": less(_ratio(closes[-1], out[f"ma_{n}"])) if out[f"ma_{n}"] is not None else None for n in (20, 60)}
    out |= {f"volatility_{n}": deviation(n) for n in (20, 60)} | {"rsi_14": strength(14), "volume_change_1": change(volumes, 1), "volume_ma_20": mean(volumes, 20)}
    return out | {"high_low_range": _ratio(bar["high"] - bar["low"], bar["close"]), "close_open_return": less(_ratio(bar["close"], bar["open"]))}


class BarFeatures(StatefulProcessor):
    """Ticks (ts, price, volume, turnover, order) of a symbol to closed bars with features."""

    def __init__(self, duration_ms: int):
        self.duration = duration_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        places = "first_at long, first_order long, last_at long, last_order long"
        self.bars = handle.getMapState("bars", "start long", ", ".join(f"{c} double" for c in _BAR) + ", " + places)
        self.past = handle.getValueState("past", "closes array<double>, volumes array<double>, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        until = self.past.get()[2] if self.past.exists() else None
        for frame in rows:
            ms = frame["ts"].to_numpy("datetime64[us]").astype("int64") // 1000
            micros = frame["ts"].to_numpy("datetime64[us]").astype("int64")
            frame = frame.assign(_start=ms - ms % self.duration, _at=micros)
            for start, part in frame.groupby("_start"):
                start = int(start)
                if until is not None and start <= until:
                    continue  # its bar is closed
                part = part.sort_values(["_at", "order"])
                a, z = part.iloc[0], part.iloc[-1]
                new = [a["price"], part["price"].max(), part["price"].min(), z["price"], part["volume"].sum(), part["turnover"].sum(), a["_at"], a["order"], z["_at"], z["order"]]
                if self.bars.containsKey((start,)):
                    old = list(self.bars.getValue((start,)))
                    first, last = (old if tuple(old[6:8]) <= tuple(new[6:8]) else new), (old if tuple(old[8:]) >= tuple(new[8:]) else new)
                    new = [first[0], max(old[1], new[1]), min(old[2], new[2]), last[3], old[4] + new[4], old[5] + new[5], *first[6:8], *last[8:]]
                else:
                    self.handle.registerTimer(start + self.duration)
                self.bars.updateValue((start,), (*map(float, new[:6]), *map(int, new[6:])))
        return iter(())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        end, out = expiredTimerInfo.getExpiryTimeInMs(), []
        closes, volumes, until = (list(self.past.get()[0]), list(self.past.get()[1]), self.past.get()[2]) if self.past.exists() else ([], [], None)
        for start in sorted(k[0] for k in self.bars.keys() if k[0] + self.duration <= end):
            bar = dict(zip(_BAR, self.bars.getValue((start,))))
            self.bars.removeKey((start,))
            closes, volumes, until = [*closes, bar["close"]][-KEPT:], [*volumes, bar["volume"]][-KEPT:], start
            out.append({"symbol": key[0], "ts": pd.Timestamp(start, unit="ms", tz="UTC"), **bar, **last_features(bar, closes, volumes)})
        if out:
            self.past.update((closes, volumes, until))
            yield pd.DataFrame(out, columns=["symbol", "ts", *_BAR, *MAIN_FEATURES]).astype(dict.fromkeys(MAIN_FEATURES, "float64"))

    def close(self) -> None:
        pass


def streaming_features(ticks: DataFrame, duration_ms: int, order: str = "event_id", delay: str = "1 hour") -> DataFrame:
    """Closed bars of a stream (symbol, ts timestamp, price, volume, turnover, order) with the features of ``indicators.main_features``.

    Ticks are late by at most ``delay``; repeats of a symbol's order within it are dropped, and so are rows without symbol, time or price. A bar
    comes out once the watermark passes its end, in order of time; ticks of a bar that is out already are dropped. Bins start at multiples of
    the duration since the epoch. Needs ``use_rocksdb``.
    """
    rows = ticks.where("symbol IS NOT NULL AND ts IS NOT NULL AND price IS NOT NULL").withWatermark("ts", delay).dropDuplicatesWithinWatermark(["symbol", order])
    rows = rows.select("symbol", "ts", "price", F.coalesce("volume", F.lit(0.0)).alias("volume"), F.coalesce("turnover", F.lit(0.0)).alias("turnover"), F.col(order).cast("long").alias("order"))
    return rows.groupBy("symbol").transformWithStateInPandas(BarFeatures(duration_ms), SCHEMA, "Append", "EventTime")
