"""A data source of kline pages: disjoint ranges of time are fetched by tasks, with retries, and normalised in Spark."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.columns import series
from ..operators.ranges import halo

PAGE, MINUTE_MS = 1_000, 60_000
#: Answers without a bar in a row after which a walk into the past ends, and most requests of one walk.
EMPTY_ANSWERS, BATCHES = 3, 1_000
#: Items of a kline record: epoch ms, open, high, low, close, volume, turnover.
ITEMS = 7


def with_retry(task: Callable[[], object], tries: int = 5, wait: float = 5.0, fail: bool = True, sleep: Callable[[float], None] = time.sleep):
    """The task's result; after each failure it waits ``wait`` times the number of tries. In the end it raises or gives None."""
    for n in range(1, tries + 1):
        try:
            return task()
        except Exception:
            if n == tries and fail:
                raise
            if n < tries:
                sleep(wait * n)
    return None


def page_ranges(start_ms: int, end_ms: int, page: int = PAGE, step_ms: int = MINUTE_MS) -> list[tuple[int, int]]:
    """Ranges that cover start to end (excluded), each with one bar of overlap to the one before."""
    return [(max(start_ms - step_ms, at - step_ms), min(end_ms, at + page * step_ms)) for at in range(start_ms, end_ms, page * step_ms)]


Record = list
Fetch = Callable[[int, int], "list[Record] | None"]


def _times(records: list[Record] | None, before: int) -> list[tuple[int, Record]]:
    """(epoch ms, record) of whole records ahead of ``before``, in order of time."""
    return sorted(((int(r[0]), r) for r in records or [] if len(r) >= ITEMS and int(r[0]) < before), key=lambda x: x[0])


def forward_pages(fetch: Fetch, start_ms: int, end_ms: int, page: int = PAGE, step_ms: int = MINUTE_MS, overlap: bool = True) -> Iterator[list[Record]]:
    """Pages from start to end (excluded), each from the last bar of the one before, or, without overlap, from the bar after it.

    With overlap the walk begins one bar ahead of the start. It ends at an answer without bars, at the last complete bar, and where time
    does not advance.
    """
    cursor = max(0, start_ms - step_ms) if overlap else start_ms
    while cursor < end_ms:
        found = _times(fetch(cursor, min(end_ms, cursor + page * step_ms)), end_ms)
        if not found:
            return
        yield [r for _, r in found]
        last = found[-1][0]
        if overlap and last >= end_ms - step_ms:
            return
        following = last + step_ms if not overlap else cursor + step_ms if last <= cursor else last
        if following <= cursor:
            return
        cursor = following


def backward_pages(fetch: Fetch, end_ms: int, batches: int = BATCHES, page: int = PAGE, step_ms: int = MINUTE_MS, empty: int = EMPTY_ANSWERS) -> Iterator[list[Record]]:
    """Pages from the end into the past, with one bar of overlap, as far as there is history.

    The walk ends after ``empty`` answers in a row without bars (each moves it a page back), where the earliest bar does not move back,
    one bar from the epoch, or after ``batches`` requests.
    """
    cursor, before, none = end_ms, None, 0
    for _ in range(batches):
        begin = max(0, cursor - page * step_ms)
        found = _times(fetch(begin, cursor), cursor)
        if not found:
            none += 1
            if none >= empty:
                return
            cursor = begin
            continue
        none = 0
        yield [r for _, r in found]
        earliest = found[0][0]
        if before is not None and earliest >= before or earliest <= step_ms:
            return
        before, cursor = earliest, earliest + step_ms


def history_begin(fetch: Fetch, end_ms: int, batches: int = BATCHES, page: int = PAGE, step_ms: int = MINUTE_MS, empty: int = EMPTY_ANSWERS) -> int | None:
    """Begin of the earliest page that holds bars, counted in whole pages back from the end, or None where a walk would find nothing.

    Probes go back by doubled steps until a page is empty, then by halving between the last full and the first empty one: their number is
    the logarithm of the history's. A walk never passes an empty page, so what lies before one is not looked for. At most ``batches`` pages are counted.
    """
    span = page * step_ms
    total = min(batches, -(-end_ms // span))
    has = lambda k: bool(_times(fetch(max(0, end_ms - (k + 1) * span), end_ms - k * span), end_ms - k * span))
    full = next((k for k in range(min(empty, total)) if has(k)), None)
    if full is None:
        return None
    jump, none = 1, total
    while full + jump < total:
        if not has(full + jump):
            none = full + jump
            break
        full, jump = full + jump, 2 * jump
    while none - full > 1:
        middle = (full + none) // 2
        full, none = (middle, none) if has(middle) else (full, middle)
    return max(0, end_ms - (full + 1) * span)


def reachable(bars: DataFrame, page: int = PAGE, step_ms: int = MINUTE_MS, rows: int | None = None) -> DataFrame:
    """The bars that a walk back reaches: those after the latest gap that a page, which holds the bar at its end again, does not cross."""
    lag = lambda df: df.withColumn("_before", F.lag("ts").over(series()))
    apart = F.unix_millis(F.col("ts").cast("timestamp")) - F.unix_millis(F.col("_before").cast("timestamp"))
    cut = halo(bars.select("symbol", "ts"), lag, 1, rows=rows).where(apart > (page - 1) * step_ms).groupBy("symbol").agg(F.max("ts").alias("_cut"))
    return bars.join(cut, "symbol", "left").where(F.col("_cut").isNull() | (F.col("ts") >= F.col("_cut"))).drop("_cut")


def require_symbol(symbol: str, known: list[str] | None) -> str:
    """The symbol, if the catalogue holds it; an error for an unknown one or without a catalogue."""
    if not known or symbol not in known:
        raise ValueError(f"{symbol} is not in the catalogue")
    return symbol


class Range(InputPartition):
    def __init__(self, begin: int, end: int):
        self.begin, self.end = begin, end


class KlineReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def _named(self, option: str) -> Callable:
        import importlib

        module, _, name = self.options[option].partition(":")
        return getattr(importlib.import_module(module), name)

    def partitions(self) -> list[Range]:
        """Ranges fetched side by side; a walk, whose steps depend on one another, is one partition."""
        if "catalogue" in self.options:
            require_symbol(self.options["symbol"], with_retry(self._named("catalogue")))
        mode, page = self.options.get("mode", "ranges"), int(self.options.get("page", PAGE))
        if mode == "history_ranges":
            fetch, symbol, end = self._named("fetch"), self.options["symbol"], int(self.options["end_ms"])
            begin = history_begin(lambda a, b: with_retry(lambda: fetch(symbol, a, b)), end, int(self.options.get("batches", BATCHES)), page)
            span = page * MINUTE_MS
            return [Range(at, min(end, at + span)) for at in range(end if begin is None else begin, end, span)] or [Range(end, end)]
        if mode != "ranges":
            return [Range(int(self.options.get("start_ms", 0)), int(self.options["end_ms"]))]
        return [Range(a, b) for a, b in page_ranges(int(self.options["start_ms"]), int(self.options["end_ms"]), int(self.options.get("page", PAGE)))]

    def read(self, partition: Range) -> Iterator[tuple[str, list[str]]]:
        """``fetch`` names a function module:attribute (symbol, begin, end) -> records; tasks import it."""
        fetch, symbol, mode, page = self._named("fetch"), self.options["symbol"], self.options.get("mode", "ranges"), int(self.options.get("page", PAGE))
        ask = lambda begin, end: with_retry(lambda: fetch(symbol, begin, end))
        if mode == "history":
            pages = backward_pages(ask, partition.end, int(self.options.get("batches", BATCHES)), page)
        elif mode in ("forward", "forward_apart"):
            pages = forward_pages(ask, partition.begin, partition.end, page, overlap=mode == "forward")
        else:
            pages = [ask(partition.begin, partition.end)] if partition.begin < partition.end else []
        for records in pages:
            for record in records or []:
                yield symbol, [None if x is None else str(x) for x in record]


class KlineSource(DataSource):
    """spark.dataSource.register(KlineSource); spark.read.format("klines").options(...).load()

    Options: symbol, fetch (module:function of symbol, begin, end), end_ms, page; ``mode``: ranges (the default, from
    start_ms on, side by side), forward or forward_apart (one walk with or without overlap), history (one walk back from end_ms, at
    most ``batches`` requests), history_ranges (the begin is found by probes, then pages are fetched side by side; ``reachable`` keeps what the walk
    would); catalogue (module:function that lists symbols), which rejects unknown symbols at the start.
    """

    @classmethod
    def name(cls) -> str:
        return "klines"

    def schema(self) -> str:
        return "symbol string, record array<string>"

    def reader(self, schema) -> KlineReader:
        return KlineReader(dict(self.options))


def parse_response(df: DataFrame, column: str = "body") -> DataFrame:
    """One row for each record of a JSON answer {result: {list: [[...], ...]}}."""
    parsed = F.from_json(column, "struct<result: struct<list: array<array<string>>>>")
    return df.withColumn("record", F.explode(parsed["result"]["list"]))


def normalise(df: DataFrame, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Bars from records: short ones and those outside the range are left out, one bar stays for each time."""
    item = lambda i: F.try_element_at("record", F.lit(i))
    ms = item(1).try_cast("long")
    rows = df.where((F.size("record") >= ITEMS) & ms.isNotNull())
    rows = rows.where(ms < end_ms) if end_ms is not None else rows
    rows = rows.where(ms >= start_ms) if start_ms is not None else rows
    names = ["open", "high", "low", "close", "volume", "turnover"]
    bars = rows.select("symbol", F.timestamp_millis(ms).cast("timestamp_ntz").alias("ts"), *[item(i).try_cast("double").alias(n) for i, n in enumerate(names, 2)])
    return bars.groupBy("symbol", "ts").agg(F.min(F.struct(*names)).alias("v")).select("symbol", "ts", "v.*")
