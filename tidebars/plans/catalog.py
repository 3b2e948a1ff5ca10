"""All queries of the library by name, with the SQL that each must equal.

Bars come from ``events``: symbol = event type, price = value, volume = k of props, turnover = their product.
Doubles are rounded to six places in both dialects.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import backtest as B
from ..operators import clean, indicators, joins, labels, metrics, models, patterns, ranges, similarity, simulate, split, stats
from ..operators.bars import resample
from ..storage import stored

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and its SQL after ``WITH`` common tables where it begins with a brace-free SELECT."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        _QUERIES[key] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            _SQL[key] = sql
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str, one: bool = False) -> DataFrame:
    """Events as trades; ``one``: of a single symbol."""
    volume = F.get_json_object("props", "$.k").cast("double")
    return _table(spark, sf_dir, "events").select((F.lit("ALL") if one else F.col("event_type")).alias("symbol"), "ts", "event_id", F.col("value").alias("price"), volume.alias("volume"), (F.col("value") * volume).alias("turnover"))


def bars(spark: SparkSession, sf_dir: str, duration: str = "1 hour", one: bool = False) -> DataFrame:
    return resample(ticks(spark, sf_dir, one), duration, ["ts", "event_id"], "price")


def bounded(spark: SparkSession, sf_dir: str, one: bool = False) -> DataFrame:
    """Hourly bars with a return within one percent and a probability-like place of the close in its range."""
    b = bars(spark, sf_dir, one=one)
    return b.withColumns({"r": (F.col("close") - F.col("open")) / (100 * F.col("high")), "p": F.coalesce(F.try_divide(F.col("close") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.5))})


_E = """WITH e AS (SELECT event_type AS symbol, ts, event_id, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume,
 value * CAST(json_extract_string(props, '$.k') AS DOUBLE) AS turnover FROM events)"""


def _bars_sql(interval: str, name: str = "b") -> str:
    return f"""{name} AS (SELECT symbol, time_bucket(INTERVAL '{interval}', ts) AS ts, first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low,
 last(price ORDER BY ts, event_id) AS close, sum(volume) AS volume, sum(turnover) AS turnover FROM e GROUP BY 1, 2)"""


_B = f"{_E}, {_bars_sql('1 hour')}"
_R = f"{_B}, x AS (SELECT *, (close - open) / (100 * high) AS r, coalesce((close - low) / nullif(high - low, 0), 0.5) AS p FROM b)"
_W = "(PARTITION BY symbol ORDER BY ts)"
_RUN = "(PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"


def _frame(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _rolled(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {_frame(n)} = {n} THEN {agg}({x}) OVER {_frame(n)} END"


def _pct(x: str, k: int) -> str:
    return f"{x} / nullif(lag({x}, {k}) OVER {_W}, 0) - 1"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars with a moving average and RSI."""
    w, close = C.series(), F.col("close")
    return rounded(bars(spark, sf_dir).withColumns({"ma_20": C.rolling(F.avg, close, 20, w), "rsi_14": C.rsi(close, 14, w)}))


# --- bars, cleaning, quality ---

for _name, _d in {"5m": "5 minutes", "15m": "15 minutes", "1h": "1 hour", "4h": "4 hours", "1d": "1 day"}.items():
    query(
        f"{_E}, {_bars_sql(_d)} SELECT symbol, ts, {', '.join(f'round({c}, 6) AS {c}' for c in ('open', 'high', 'low', 'close', 'volume', 'turnover'))} FROM b", f"bars_{_name}"
    )(lambda spark, sf_dir, d=_d: bars(spark, sf_dir, d))

_DIRTY = f"""{_E}, d AS (SELECT symbol, CASE WHEN event_id % 7 = 0 THEN 'bad' ELSE strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') END AS ts,
 CASE WHEN event_id % 11 = 0 THEN 'x' ELSE CAST(event_id AS VARCHAR) END AS close, event_id FROM e)"""


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ticks(spark, sf_dir)
    ts = F.when(F.col("event_id") % 7 == 0, "bad").otherwise(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss"))
    return e.select("symbol", ts.alias("ts"), F.when(F.col("event_id") % 11 == 0, "x").otherwise(F.col("event_id").cast("string")).alias("close"), "event_id")


@query(f"{_DIRTY} SELECT symbol, TRY_CAST(ts AS TIMESTAMP) AS ts, TRY_CAST(close AS DOUBLE) AS close FROM d WHERE TRY_CAST(ts AS TIMESTAMP) IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY event_id) = 1")
def clean_coerce(spark, sf_dir):
    return clean.clean_bars(_dirty(spark, sf_dir), "event_id", ["close"])


@query(f"{_DIRTY} SELECT symbol, count(*) - count(DISTINCT TRY_CAST(ts AS TIMESTAMP)) AS removed FROM d GROUP BY 1")
def removed_rows(spark, sf_dir):
    return clean.removed_rows(_dirty(spark, sf_dir))


@query("SELECT o_custkey, o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def dedup_keep_first(spark, sf_dir):
    return clean.keep_first(_table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query(f"{_B}, c AS (SELECT symbol, ts, close, {_pct('volume', 1)} AS change FROM b) SELECT symbol, ts, round(close, 6) AS close, round(change, 6) AS change FROM c WHERE close IS NOT NULL AND change IS NOT NULL")
def drop_incomplete(spark, sf_dir):
    b = bars(spark, sf_dir)
    return clean.drop_incomplete(b.select("symbol", "ts", "close", C.pct_change(F.col("volume"), 1, C.series()).alias("change")))


@query(f"{_B}, s AS (SELECT *, ts - lag(ts) OVER {_W} AS step FROM b) SELECT symbol, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts, count(ts) - count(DISTINCT ts) AS duplicates, CAST(sum(CAST(open IS NULL AS INT)) AS BIGINT) AS null_cells, count(*) FILTER (step <> INTERVAL 1 HOUR) AS odd_steps FROM s GROUP BY 1")
def quality_report(spark, sf_dir):
    return clean.quality_report(bars(spark, sf_dir), "INTERVAL 1 HOUR")


@query(f"{_B}, s AS (SELECT symbol, lag(ts) OVER {_W} AS previous_ts, ts FROM b) SELECT symbol, previous_ts, ts, CAST(epoch(ts) - epoch(previous_ts) AS BIGINT) AS gap_seconds FROM s WHERE ts - previous_ts > INTERVAL 1 HOUR")
def gap_list(spark, sf_dir):
    return clean.gaps(bars(spark, sf_dir), "INTERVAL 1 HOUR")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract_volume(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT event_id, epoch_us(ts) // 1000 AS ms, make_timestamp(epoch_us(ts) // 1000 * 1000) AS ts, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute FROM events")
def epoch_roundtrip(spark, sf_dir):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return _table(spark, sf_dir, "events").select("event_id", ms.alias("ms"), F.timestamp_millis(ms).cast("timestamp_ntz").alias("ts"), F.date_format(F.date_trunc("minute", "ts"), "yyyy-MM-dd HH:mm").alias("minute"))


@query("SELECT p_partkey, lower(p_name) AS name FROM part WHERE starts_with(lower(p_name), 's') OR contains(lower(p_name), 'widget')")
def prefix_filter(spark, sf_dir):
    name = F.lower("p_name")
    return _table(spark, sf_dir, "part").select("p_partkey", name.alias("name")).where(F.col("name").startswith("s") | F.col("name").contains("widget"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def semi_isin(spark, sf_dir):
    some = _table(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey"))
    return _table(spark, sf_dir, "orders").join(some, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


# --- indicators ---


def _add(spark, sf_dir, **columns) -> DataFrame:
    return bars(spark, sf_dir).withColumns(columns).select("symbol", "ts", *columns)


@query(f"{_B} SELECT symbol, ts, {', '.join(f'round({_pct("close", k)}, 6) AS return_{k}' for k in (1, 3, 5, 10))} FROM b")
def returns_k(spark, sf_dir):
    return _add(spark, sf_dir, **{f"return_{k}": C.pct_change(F.col("close"), k, C.series()) for k in (1, 3, 5, 10)})


@query(f"{_B} SELECT symbol, ts, {', '.join(f'round({_rolled("avg", "close", n)}, 6) AS ma_{n}' for n in (20, 60, 120))} FROM b")
def rolling_mean(spark, sf_dir):
    return _add(spark, sf_dir, **{f"ma_{n}": C.rolling(F.avg, F.col("close"), n, C.series()) for n in (20, 60, 120)})


@query(f"{_B}, m AS (SELECT symbol, ts, close, {_rolled('avg', 'close', 240)} AS m FROM b) SELECT symbol, ts, round(close / nullif(m, 0), 6) AS close_sma_ratio FROM m")
def sma_ratio(spark, sf_dir):
    return _add(spark, sf_dir, close_sma_ratio=F.try_divide("close", C.prefix_mean(F.col("close"), 240, C.series())))


_LONG = {"5d": 480, "20d": 1_920, "60d": 5_760}


@query(f"{_E}, {_bars_sql('5 minutes')} SELECT symbol, ts, {', '.join(f'round(close / nullif({_rolled("avg", "close", n)}, 0), 6) AS close_sma_{k}_ratio' for k, n in _LONG.items())} FROM b")
def sma_ratios_long(spark, sf_dir):
    return indicators.day_features(bars(spark, sf_dir, "5 minutes")).select("symbol", "ts", *[f"close_sma_{k}_ratio" for k in _LONG])


@query(f"{_B}, m AS (SELECT symbol, ts, close, {_rolled('avg', 'close', 20)} AS m FROM b) SELECT symbol, ts, round(close / nullif(m, 0) - 1, 6) AS ma_distance_20 FROM m")
def ma_distance(spark, sf_dir):
    return indicators.main_features(bars(spark, sf_dir)).select("symbol", "ts", "ma_distance_20")


@query(f"{_B}, m AS (SELECT symbol, ts, {_pct('close', 1)} AS r FROM b) SELECT symbol, ts, round({_rolled('stddev_samp', 'r', 20)}, 6) AS volatility_20 FROM m")
def rolling_std(spark, sf_dir):
    return indicators.main_features(bars(spark, sf_dir)).select("symbol", "ts", "volatility_20")


@query(f"{_B}, m AS (SELECT symbol, ts, {_rolled('avg', 'close', 20)} AS m, {_rolled('stddev_pop', 'close', 20)} AS s FROM b) SELECT symbol, ts, round(4 * s / nullif(m, 0), 6) AS bb_bandwidth_20 FROM m")
def bollinger(spark, sf_dir):
    return indicators.day_features(bars(spark, sf_dir), {"20": 20}).select("symbol", "ts", "bb_bandwidth_20")


_RSI = f"""d AS (SELECT symbol, ts, close - lag(close) OVER {_W} AS d FROM b), g AS (SELECT symbol, ts, d, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS up, CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS down FROM d),
 a AS (SELECT symbol, ts, {_rolled('avg', 'up', 14)} AS u, {_rolled('avg', 'down', 14)} AS l FROM g)"""


@query(f"{_B}, {_RSI} SELECT symbol, ts, round(CASE WHEN u IS NULL THEN NULL WHEN l = 0 AND u = 0 THEN 50 WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + u / l) END, 6) AS rsi_14 FROM a")
def rsi(spark, sf_dir):
    return _add(spark, sf_dir, rsi_14=C.rsi(F.col("close"), 14, C.series()))


@query(f"{_B} SELECT symbol, ts, round(volume / nullif({_rolled('avg', 'volume', 20)}, 0), 6) AS volume_ratio_20 FROM b")
def volume_ratio(spark, sf_dir):
    return indicators.day_features(bars(spark, sf_dir), {"20": 20}).select("symbol", "ts", "volume_ratio_20")


@query(f"{_B} SELECT symbol, ts, round((high - low) / nullif(close, 0), 6) AS high_low_range, round(close / nullif(open, 0) - 1, 6) AS close_open_return FROM b")
def candle_shape(spark, sf_dir):
    return indicators.main_features(bars(spark, sf_dir)).select("symbol", "ts", "high_low_range", "close_open_return")


@query(f"{_B}, m AS (SELECT symbol, ts, {_rolled('avg', 'close', 20)} AS a, {_rolled('avg', 'close', 60)} AS z FROM b) SELECT symbol, ts, coalesce(CAST(a > z AS INT), 0) AS trend FROM m")
def trend_flag(spark, sf_dir):
    w = C.series()
    return _add(spark, sf_dir, trend=C.flag(C.rolling(F.avg, F.col("close"), 20, w) > C.rolling(F.avg, F.col("close"), 60, w)))


def _aux_sql(interval: str, prefix: str, name: str) -> str:
    m = f"{name}_m AS (SELECT symbol, ts, close, {_pct('close', 1)} AS r, {_rolled('avg', 'close', 20)} AS a, {_rolled('avg', 'close', 60)} AS z FROM {name}_b)"
    out = f"{name} AS (SELECT symbol, ts + INTERVAL '{interval}' AS ts, r AS {prefix}_return_1, a AS {prefix}_ma_20, z AS {prefix}_ma_60, close / nullif(a, 0) - 1 AS {prefix}_ma_distance_20, CAST(a > z AS INT) AS {prefix}_trend FROM {name}_m WHERE r IS NOT NULL AND a IS NOT NULL AND z IS NOT NULL)"
    return f"{_bars_sql(interval, name + '_b')}, {m}, {out}"


def _aux_columns(prefix: str) -> str:
    return ", ".join(f"round({prefix}_{c}, 6) AS {prefix}_{c}" for c in ("return_1", "ma_20", "ma_60", "ma_distance_20")) + f", {prefix}_trend"


@query(f"{_E}, {_aux_sql('1 hour', 'h1', 'a')} SELECT symbol, ts, {_aux_columns('h1')} FROM a")
def aux_block(spark, sf_dir):
    return indicators.aux_features(bars(spark, sf_dir), "h1", "1 hour")


@query(f"{_E}, {_bars_sql('15 minutes')}, {_aux_sql('1 hour', 'h1', 'a')} SELECT b.symbol, b.ts, round(b.close, 6) AS close, {_aux_columns('h1')} FROM b ASOF LEFT JOIN a ON b.symbol = a.symbol AND b.ts >= a.ts WHERE a.ts IS NOT NULL")
def asof_join(spark, sf_dir):
    main = bars(spark, sf_dir, "15 minutes").select("symbol", "ts", "close")
    return joins.asof_join(main, indicators.aux_features(bars(spark, sf_dir), "h1", "1 hour")).where("h1_trend IS NOT NULL")


@query(
    f"""{_E}, {_bars_sql('15 minutes')}, {_aux_sql('1 hour', 'h1', 'a')}, {_aux_sql('4 hours', 'h4', 'c')} SELECT b.symbol, b.ts, round(b.close, 6) AS close, {_aux_columns('h1')}, {_aux_columns('h4')} FROM b
 ASOF LEFT JOIN a ON b.symbol = a.symbol AND b.ts >= a.ts ASOF LEFT JOIN c ON b.symbol = c.symbol AND b.ts >= c.ts WHERE a.ts IS NOT NULL AND c.ts IS NOT NULL"""
)
def asof_two_levels(spark, sf_dir):
    main = bars(spark, sf_dir, "15 minutes").select("symbol", "ts", "close")
    one = joins.asof_join(main, indicators.aux_features(bars(spark, sf_dir), "h1", "1 hour"))
    return joins.asof_join(one, indicators.aux_features(bars(spark, sf_dir, "4 hours"), "h4", "4 hours")).where("h1_trend IS NOT NULL AND h4_trend IS NOT NULL")


# --- joins ---


@query(f"{_B}, {_RSI} SELECT a.symbol, a.ts, round(b.close, 6) AS close FROM a LEFT JOIN b ON a.symbol = b.symbol AND a.ts = b.ts")
def left_join_checked(spark, sf_dir):
    b = bars(spark, sf_dir)
    return joins.left_join_checked(b.select("symbol", "ts"), b.select("symbol", "ts", "close"), ["symbol", "ts"])


@query(f"{_E}, {_bars_sql('1 hour')}, {_bars_sql('4 hours', 'f')} SELECT b.symbol, b.ts, round(b.close, 6) AS close, round(f.close, 6) AS close_4h FROM b JOIN f ON b.symbol = f.symbol AND b.ts = f.ts")
def inner_join_one_to_one(spark, sf_dir):
    long = bars(spark, sf_dir, "4 hours").select("symbol", "ts", F.col("close").alias("close_4h"))
    return joins.inner_join_one_to_one(bars(spark, sf_dir).select("symbol", "ts", "close"), long, ["symbol", "ts"])


@query(f"{_E}, {_bars_sql('1 hour')}, {_bars_sql('4 hours', 'f')}, u AS (SELECT symbol, ts, close, 0 AS s FROM f UNION ALL SELECT symbol, ts, close, 1 FROM b) SELECT symbol, ts, round(close, 6) AS close FROM u QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY s) = 1")
def union_upsert(spark, sf_dir):
    return clean.upsert(bars(spark, sf_dir, "4 hours").select("symbol", "ts", "close"), bars(spark, sf_dir).select("symbol", "ts", "close"))


# --- labels and splits ---


@query(f"{_B}, l AS (SELECT symbol, ts, lead(close) OVER {_W} / nullif(close, 0) - 1 AS r FROM b) SELECT symbol, ts, round(r, 6) AS target_return_next, coalesce(CAST(r > 0 AS INT), 0) AS target_up_next FROM l")
def next_bar_label(spark, sf_dir):
    return labels.next_bar(bars(spark, sf_dir)).select("symbol", "ts", "target_return_next", "target_up_next")


for _h in (4, 16, 96):
    query(f"{_B} SELECT symbol, ts, round(lead(close, {_h}) OVER {_W} / nullif(close, 0) - 1, 6) AS target_return_next_{_h} FROM b", f"forward_return_{_h}")(
        lambda spark, sf_dir, h=_h: _add(spark, sf_dir, **{f"target_return_next_{h}": C.forward_return(F.col("close"), h, C.series())})
    )


def _horizon_sql(h: int, t: float) -> str:
    """Common tables l{h}: the labels of a horizon of bars b (with r1, the last return, in s)."""
    f = f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    return f"""u{h} AS (SELECT symbol, ts, lead(close, {h}) OVER {_W} / nullif(close, 0) - 1 AS r, CASE WHEN count(r1) OVER {f} = {h} THEN stddev_samp(r1) OVER {f} END AS v FROM s), q{h} AS (SELECT symbol, quantile_cont(v, 0.7) AS q FROM u{h} GROUP BY 1),
 l{h} AS (SELECT u{h}.symbol, ts, r AS target_return_next_{h}, v AS target_volatility_next_{h}, abs(r) AS target_abs_return_next_{h}, CAST(abs(r) >= {t} AS INT) AS target_big_move_next_{h}, CAST(r <= -{t} AS INT) AS target_drop_next_{h}, CAST(r >= {t} AS INT) AS target_pump_next_{h}, CAST(v >= q AS INT) AS target_volatility_high_next_{h} FROM u{h} JOIN q{h} ON u{h}.symbol = q{h}.symbol WHERE r IS NOT NULL AND v IS NOT NULL)"""


def _labels_sql(h: int, t: float) -> str:
    f = f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    return f"""{_B}, s AS (SELECT symbol, ts, close, {_pct('close', 1)} AS r1 FROM b), l AS (SELECT symbol, ts, lead(close, {h}) OVER {_W} / nullif(close, 0) - 1 AS r,
 CASE WHEN count(r1) OVER {f} = {h} THEN stddev_samp(r1) OVER {f} END AS v FROM s), q AS (SELECT symbol, quantile_cont(v, 0.7) AS q FROM l GROUP BY 1)"""


@query(_labels_sql(4, 0.01) + " SELECT symbol, ts, round(v, 6) AS target_volatility_next_4 FROM l")
def forward_vol(spark, sf_dir):
    return labels.horizon_labels(bars(spark, sf_dir), 4).select("symbol", "ts", "target_volatility_next_4")


@query(_labels_sql(4, 0.01) + " SELECT symbol, ts, round(abs(r), 6) AS target_abs_return_next_4, " + ", ".join(f"coalesce(CAST({c} AS INT), 0) AS target_{n}_next_4" for n, c in (("big_move", "abs(r) >= 0.01"), ("drop", "r <= -0.01"), ("pump", "r >= 0.01"))) + " FROM l")
def event_labels(spark, sf_dir):
    return labels.horizon_labels(bars(spark, sf_dir), 4).select("symbol", "ts", *[f"target_{n}_next_4" for n in ("abs_return", "big_move", "drop", "pump")])


@query(_labels_sql(4, 0.01) + " SELECT l.symbol, ts, coalesce(CAST(v >= q AS INT), 0) AS target_volatility_high_next_4 FROM l JOIN q ON l.symbol = q.symbol")
def high_vol_label(spark, sf_dir):
    return labels.horizon_labels(bars(spark, sf_dir), 4).select("symbol", "ts", "target_volatility_high_next_4")


@query(_labels_sql(4, 0.01) + ", f AS (SELECT l.symbol, v >= q AS y FROM l JOIN q ON l.symbol = q.symbol WHERE v IS NOT NULL AND r IS NOT NULL) SELECT symbol, count(*) FILTER (NOT y) AS n_0, count(*) FILTER (y) AS n_1, round(count(*) FILTER (NOT y) / count(*), 6) AS ratio_0, round(count(*) FILTER (y) / count(*), 6) AS ratio_1 FROM f GROUP BY 1")
def class_ratio(spark, sf_dir):
    return labels.class_ratios(labels.risk_labels(bars(spark, sf_dir)), "target_volatility_high_next_4")


_SWING = ["target_return_next", "target_volatility_next", "target_abs_return_next", "target_big_move_next", "target_drop_next", "target_pump_next", "target_volatility_high_next"]


@query(f"{_B}, s AS (SELECT symbol, ts, close, {_pct('close', 1)} AS r1 FROM b), {_horizon_sql(16, 0.02)}, {_horizon_sql(96, 0.04)} SELECT a.symbol, a.ts, {', '.join(f'round({c}_{h}, 6) AS {c}_{h}' if i < 3 else f'{c}_{h}' for h in (16, 96) for i, c in enumerate(_SWING))} FROM l16 a JOIN l96 z ON a.symbol = z.symbol AND a.ts = z.ts")
def swing_labels(spark, sf_dir):
    return labels.swing_labels(bars(spark, sf_dir)).select("symbol", "ts", *[f"{c}_{h}" for h in (16, 96) for c in _SWING])


_RN = f"{_B}, n AS (SELECT symbol, ts, row_number() OVER {_W} AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM b)"


@query(_RN + " SELECT symbol, ts, CASE WHEN rn <= floor(n * 0.8e0) THEN 'train' ELSE 'test' END AS split FROM n")
def split_80_20(spark, sf_dir):
    return split.split_two(bars(spark, sf_dir)).select("symbol", "ts", "split")


@query(_RN + ", s AS (SELECT symbol, ts, CASE WHEN rn <= floor(n * 0.7e0) THEN 'train' WHEN rn <= floor(n * 0.85e0) THEN 'valid' ELSE 'test' END AS split FROM n) SELECT symbol, split, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY 1, 2")
def split_70_15_15(spark, sf_dir):
    return split.split_periods(split.split_three(bars(spark, sf_dir)))


@query(_RN + " SELECT symbol, ts FROM n WHERE rn - 1 >= floor(n * 0.3e0) AND (rn - 1 - floor(n * 0.3e0)) % 16 = 0 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 20")
def step_sample(spark, sf_dir):
    return split.step_sample(bars(spark, sf_dir), 16, 20).select("symbol", "ts")


# --- patterns and similarity ---


@query(f"{_R} SELECT 'r' AS feature, round(avg(r), 6) AS mean, round(stddev_pop(r), 6) AS std FROM x UNION ALL SELECT 'p', round(avg(p), 6), round(stddev_pop(p), 6) FROM x")
def scaler_fit(spark, sf_dir):
    return patterns.fit_scaler(bounded(spark, sf_dir).withColumn("flat", F.lit(1.0)), ["r", "p", "flat"])


@query(f"{_R}, m AS (SELECT avg(p) AS m, stddev_pop(p) AS s FROM x) SELECT symbol, ts, round((p - m) / s, 6) AS p FROM x, m")
def zscore(spark, sf_dir):
    x = bounded(spark, sf_dir)
    return patterns.scale(x, patterns.fit_scaler(x, ["p"])).select("symbol", "ts", "p")


_F16 = _frame(16)


@query(f"{_R} SELECT symbol, lag(ts, 15) OVER {_W} AS window_start_ts, ts AS window_end_ts, 16 AS pattern_length, round(avg(p) OVER {_F16}, 6) AS p_mean, round(stddev_pop(p) OVER {_F16}, 6) AS p_std, round(min(p) OVER {_F16}, 6) AS p_min, round(max(p) OVER {_F16}, 6) AS p_max, round(p, 6) AS p_last, round(lag(p, 15) OVER {_W}, 6) AS p_first, round(p - lag(p, 15) OVER {_W}, 6) AS p_change FROM x QUALIFY row_number() OVER {_W} >= 16")
def window_stats(spark, sf_dir):
    return patterns.pattern_summary(bounded(spark, sf_dir), ["p"], 16)


@query(f"{_R} SELECT symbol, ts AS window_end_ts, CAST(32 AS INT) AS n_values, round(sum(CAST(CAST(p AS FLOAT) AS DOUBLE)) OVER {_F16} + 1000 * sum(CAST(CAST(r AS FLOAT) AS DOUBLE)) OVER {_F16}, 6) AS total FROM x QUALIFY row_number() OVER {_W} >= 16")
def window_vector(spark, sf_dir):
    v = patterns.pattern_vectors(bounded(spark, sf_dir), ["p", "r"], 16)
    part = lambda i: F.aggregate(F.slice("vector", i, 16), F.lit(0.0), lambda s, x: s + x.cast("double"))
    return v.select("symbol", "window_end_ts", F.size("vector").alias("n_values"), (part(1) + 1000 * part(17)).alias("total"))


@query(f"{_R}, l AS (SELECT symbol, ts AS window_end_ts, unnest(range(4)) AS lag, [p, lag(p, 1) OVER {_W}, lag(p, 2) OVER {_W}, lag(p, 3) OVER {_W}] AS v, row_number() OVER {_W} AS rn FROM x) SELECT symbol, window_end_ts, 'p' AS feature, CAST(lag AS INT) AS lag, round(CAST(CAST(v[lag + 1] AS FLOAT) AS DOUBLE), 5) AS value FROM l WHERE rn >= 4")
def lag_explode(spark, sf_dir):
    rows = patterns.lag_rows(patterns.pattern_vectors(bounded(spark, sf_dir), ["p"], 4), ["p"], 4)
    return rows.withColumns({"value": F.round(F.col("value").cast("double"), 5), "lag": F.col("lag").cast("int")})


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(f"WITH q AS (SELECT * FROM embeddings ORDER BY vec_id DESC LIMIT 1) SELECT b.vec_id, round({_COS}, 6) AS similarity, CAST(row_number() OVER (ORDER BY {_COS} DESC, b.vec_id) AS INT) AS rank FROM q a, embeddings b WHERE b.vec_id < a.vec_id QUALIFY rank <= 10")
def cosine_topk_latest(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector")
    last = e.orderBy(F.desc("vec_id")).limit(1)
    return similarity.topk_latest(e, last, 10, "vec_id", F.col("vec_id") < last.first()["vec_id"]).select("vec_id", "similarity", "rank")


def _per_eval(spark, sf_dir) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector")
    return similarity.topk_per_eval(e, e.where("vec_id % 100 = 0"), 10, "vec_id", cutoff=F.col("vec_id") - 5)


_TOP = f"WITH t AS (SELECT a.vec_id AS eval_vec_id, a.label AS eval_label, b.vec_id, b.label, {_COS} AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON b.vec_id < a.vec_id - 5 WHERE a.vec_id % 100 = 0 QUALIFY rank <= 10)"


@query(_TOP + " SELECT eval_vec_id, vec_id, round(similarity, 6) AS similarity, CAST(rank AS INT) AS rank FROM t")
def cosine_topk_per_eval(spark, sf_dir):
    return _per_eval(spark, sf_dir).select("eval_vec_id", "vec_id", "similarity", "rank")


_SUM = _TOP + """, s AS (SELECT eval_vec_id, count(*) AS n_similar, avg(similarity) AS mean_similarity, min(similarity) AS min_similarity, max(similarity) AS max_similarity, avg(CAST(label % 2 = 1 AS INT)) AS similar_up_ratio,
 avg(label) AS similar_avg_label, median(label) AS similar_median_label, avg(CAST(label % 3 = 0 AS INT)) AS similar_high_vol_ratio, avg(CAST(label = 1 AS INT)) AS similar_drop_ratio FROM t GROUP BY 1)"""


def _summary(spark, sf_dir) -> DataFrame:
    top = _per_eval(spark, sf_dir).withColumns({"up": (F.col("label") % 2 == 1).cast("int"), "hv": (F.col("label") % 3 == 0).cast("int"), "dp": (F.col("label") == 1).cast("int")})
    return similarity.similar_summary(top, ["eval_vec_id"], "up", ["label"], {"similar_high_vol_ratio": "hv", "similar_drop_ratio": "dp"})


@query(_SUM + " SELECT eval_vec_id, n_similar, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("mean_similarity", "min_similarity", "max_similarity", "similar_up_ratio", "similar_avg_label", "similar_median_label", "similar_high_vol_ratio", "similar_drop_ratio")) + " FROM s")
def similar_risk_summary(spark, sf_dir):
    return _summary(spark, sf_dir)


@query(
    _SUM
    + """, l AS (SELECT eval_vec_id, CASE WHEN similar_high_vol_ratio >= 0.6 THEN 'HIGH' WHEN similar_high_vol_ratio >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS high_vol_level,
 CASE WHEN similar_drop_ratio >= 0.15 THEN 'HIGH' WHEN similar_drop_ratio >= 0.07 THEN 'MEDIUM' ELSE 'LOW' END AS drop_risk_level, CASE WHEN similar_up_ratio >= 0.6 THEN 'BULLISH_HINT' WHEN similar_up_ratio <= 0.4 THEN 'BEARISH_HINT' ELSE 'NO_CLEAR_EDGE' END AS direction_hint FROM s)
 SELECT *, CASE WHEN high_vol_level = 'HIGH' AND drop_risk_level IN ('MEDIUM', 'HIGH') THEN 'NO_TRADE' WHEN high_vol_level = 'HIGH' OR drop_risk_level = 'MEDIUM' THEN 'CAUTION' ELSE 'NORMAL' END AS action_hint FROM l"""
)
def risk_levels(spark, sf_dir):
    return similarity.with_levels(_summary(spark, sf_dir)).select("eval_vec_id", "high_vol_level", "drop_risk_level", "direction_hint", "action_hint")


# --- walk-forward evaluation of pattern windows ---

_OUTCOMES = {"target_up_next": ("similar_up_ratio", "actual_target_up_next"), "target_return_next": ("similar_avg_return_next", "actual_return_next"), "target_return_next_4": ("similar_avg_return_next_4", "actual_return_next_4"), "target_volatility_high_next_4": ("similar_high_vol_ratio", "actual_high_vol"), "target_drop_next_4": ("similar_drop_ratio", "actual_drop"), "target_big_move_next_4": ("similar_big_move_ratio", "actual_big_move"), "target_pump_next_4": ("similar_pump_ratio", "actual_pump"), "target_volatility_next_4": ("similar_volatility_next_4_mean", None)}
_F8 = _frame(8)
_WALK = f"""{_labels_sql(4, 0.01)}, x AS (SELECT *, coalesce((close - low) / nullif(high - low, 0), 0.5) AS p, lead(close) OVER {_W} / nullif(close, 0) - 1 AS target_return_next FROM b),
 o AS (SELECT x.symbol, x.ts, p, target_return_next, CAST(target_return_next > 0 AS INT) AS target_up_next, r AS target_return_next_4, v AS target_volatility_next_4, CAST(abs(r) >= 0.01 AS INT) AS target_big_move_next_4, CAST(r <= -0.01 AS INT) AS target_drop_next_4, CAST(r >= 0.01 AS INT) AS target_pump_next_4, CAST(v >= q AS INT) AS target_volatility_high_next_4
  FROM x JOIN l ON x.symbol = l.symbol AND x.ts = l.ts JOIN q ON x.symbol = q.symbol WHERE target_return_next IS NOT NULL AND r IS NOT NULL AND v IS NOT NULL),
 w AS (SELECT *, lag(ts, 7) OVER {_W} AS window_start_ts, list(CAST(p AS FLOAT)) OVER {_F8} AS vec, list_sum(list_transform(list(CAST(p AS FLOAT)) OVER {_F8}, lambda y: y * y)) > 0 AS nz FROM o QUALIFY row_number() OVER {_W} >= 8),
 k AS (SELECT *, row_number() OVER {_W} AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM w),
 ev AS (SELECT * FROM k WHERE rn - 1 >= floor(n * 0.3e0) AND (rn - 1 - floor(n * 0.3e0)) % 16 = 0 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 20),
 m AS (SELECT a.symbol, a.window_start_ts AS eval_window_start_ts, a.ts AS eval_window_end_ts, {", ".join(f"a.{c} AS a_{c}" for c, (_, n) in _OUTCOMES.items() if n)}, {", ".join(f"b.{c}" for c in _OUTCOMES)}, list_cosine_similarity(a.vec::DOUBLE[], b.vec::DOUBLE[]) AS sim, b.ts AS bts,
  count(*) OVER (PARTITION BY a.symbol, a.ts) AS candidate_count FROM ev a JOIN w b ON a.symbol = b.symbol AND b.ts < a.ts - INTERVAL 1 DAY WHERE a.nz AND b.nz),
 t AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY symbol, eval_window_end_ts ORDER BY round(sim, 9) DESC, bts) <= 10),
 wf AS (SELECT symbol, eval_window_start_ts, eval_window_end_ts, 8 AS pattern_length, candidate_count, 10 AS top_k, avg(sim) AS mean_similarity, min(sim) AS min_similarity, max(sim) AS max_similarity, {", ".join(f"avg({c}) AS {n}" for c, (n, _) in _OUTCOMES.items())}, {", ".join(f"max(a_{c}) AS {n}" for c, (_, n) in _OUTCOMES.items() if n)} FROM t GROUP BY ALL HAVING count(*) = 10)"""
_WALK_ROUNDED = ["mean_similarity", "min_similarity", "max_similarity", *[n for n, _ in _OUTCOMES.values()], "actual_return_next", "actual_return_next_4"]
_WALK_PLAIN = ["symbol", "eval_window_start_ts", "eval_window_end_ts", "pattern_length", "candidate_count", "top_k", "actual_target_up_next", "actual_high_vol", "actual_drop", "actual_big_move", "actual_pump"]


def _walk(spark, sf_dir) -> DataFrame:
    rows = labels.risk_labels(labels.next_bar(bounded(spark, sf_dir)))
    windows = patterns.pattern_vectors(rows, ["p"], 8, list(_OUTCOMES))
    evals = split.step_sample(windows.withColumn("ts", F.col("window_end_ts")), 16, 20).drop("ts")
    return similarity.walk_forward(windows, evals, 10, "INTERVAL 1 DAY")


@query(f"{_WALK} SELECT {', '.join(_WALK_PLAIN)}, {', '.join(f'round({c}, 6) AS {c}' for c in _WALK_ROUNDED)} FROM wf")
def walk_forward(spark, sf_dir):
    return _walk(spark, sf_dir)


_NEXT_PAIRS = [("similar_high_vol_ratio", "actual_high_vol"), ("similar_avg_return_next_4", "actual_return_next_4")]


def _rank_sql(x: str, y: str) -> str:
    rank = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2"
    return f"SELECT '{x}' AS x, '{y}' AS y, round(corr({x}, {y}), 6) AS pearson, round(corr(a, b), 6) AS spearman FROM (SELECT {x}, {y}, {rank(x)} AS a, {rank(y)} AS b FROM wf)"


@query(f"{_WALK} {' UNION ALL '.join(_rank_sql(x, y) for x, y in _NEXT_PAIRS)}")
def walk_forward_correlations(spark, sf_dir):
    return stats.rank_correlations(_walk(spark, sf_dir), _NEXT_PAIRS)


def _report_sql(source: str, edges: list[float], names: list[str], means: dict[str, str]) -> str:
    case = " ".join(f"WHEN z >= {a} AND z < {b} THEN {i}" for i, (a, b) in enumerate(zip(edges, edges[1:])))
    return f"{_R}, n AS (SELECT unnest(range({len(names)})) AS i, unnest({names}) AS bucket), k AS (SELECT *, CASE {case} END AS i FROM (SELECT *, {source} AS z FROM x)) SELECT CAST(n.i AS INT) AS bucket_order, n.bucket, count(k.symbol) AS count, {', '.join(f'round(avg({c}), 6) AS {m}' for m, c in means.items())} FROM n LEFT JOIN k ON n.i = k.i GROUP BY 1, 2"


for _report, _source in {"drop": "p / 4", "up": "p"}.items():
    _, _edges, _names = stats.BUCKETS[_report]
    _means = {"avg_r": "r", "avg_volume": "volume"}
    query(_report_sql(_source, _edges, _names, _means), f"bucket_report_{_report}")(
        lambda spark, sf_dir, e=_edges, n=_names, x=_source, m=_means: stats.bucket_table(bounded(spark, sf_dir).withColumn("z", F.expr(x)), "z", e, n, m)
    )


# --- statistics ---


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS pearson FROM lineitem")
def pearson(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").agg(stats.pearson(F.col("l_quantity"), F.col("l_extendedprice")).alias("pearson"))


@query(f"{_R}, k AS (SELECT rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS a, rank() OVER (ORDER BY volume) + (count(*) OVER (PARTITION BY volume) - 1) / 2 AS b FROM x) SELECT round(corr(a, b), 6) AS spearman FROM k")
def spearman(spark, sf_dir):
    return stats.spearman(bounded(spark, sf_dir), "p", "volume")


@query(f"{_R} SELECT 'p' AS x, 'volume' AS y, round(corr(p, volume), 6) AS pearson FROM x UNION ALL SELECT 'r', 'volume', round(corr(r, volume), 6) FROM x UNION ALL SELECT 'r', 'flat', NULL")
def correlation_table(spark, sf_dir):
    return stats.correlations(bounded(spark, sf_dir).withColumn("flat", F.lit(1.0)), [("p", "volume"), ("r", "volume"), ("r", "flat")])


def _buckets(spark, sf_dir) -> DataFrame:
    _, edges, names = stats.BUCKETS["high_vol"]
    return stats.bucket_table(bounded(spark, sf_dir).where("p < 0.4 OR p >= 0.6"), "p", edges, names, {"avg_r": "r", "avg_volume": "volume"})


_BUCKET = f"""{_R}, n AS (SELECT unnest([0, 1, 2, 3, 4]) AS bucket_order, unnest(['0.0-0.2', '0.2-0.4', '0.4-0.6', '0.6-0.8', '0.8-1.0']) AS bucket),
 k AS (SELECT bucket_order, bucket, count(r) AS count, avg(r) AS avg_r, avg(volume) AS avg_volume FROM n LEFT JOIN (SELECT *, CASE WHEN p < 0.2 THEN 0 WHEN p < 0.4 THEN 1 WHEN p < 0.6 THEN 2 WHEN p < 0.8 THEN 3 ELSE 4 END AS i FROM x WHERE p < 0.4 OR p >= 0.6) z ON z.i = bucket_order GROUP BY 1, 2)"""


@query(_BUCKET + " SELECT bucket_order, bucket, count, round(avg_r, 6) AS avg_r, round(avg_volume, 6) AS avg_volume FROM k")
def bucket_table(spark, sf_dir):
    return _buckets(spark, sf_dir)


@query(_BUCKET + ", s AS (SELECT avg_r - lag(avg_r) OVER (ORDER BY bucket_order) AS d FROM k WHERE count > 0) SELECT CASE WHEN bool_and(d >= 0) THEN 'increasing' WHEN bool_and(d <= 0) THEN 'decreasing' ELSE 'mixed' END AS direction FROM s")
def monotonic(spark, sf_dir):
    return stats.monotonic(_buckets(spark, sf_dir), "avg_r")


@query("SELECT l_returnflag, count(l_quantity) AS count, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, round(min(l_quantity), 6) AS min, round(quantile_cont(l_quantity, 0.25), 6) AS q25, round(quantile_cont(l_quantity, 0.5), 6) AS q50, round(quantile_cont(l_quantity, 0.75), 6) AS q75, round(max(l_quantity), 6) AS max FROM lineitem GROUP BY 1")
def describe(spark, sf_dir):
    return stats.describe(_table(spark, sf_dir, "lineitem"), "l_quantity", ("l_returnflag",))


# --- backtests ---

_EQ = f"{_R}, q AS (SELECT *, product(1 + r) OVER {_RUN} AS equity FROM x)"


@query(_EQ + " SELECT symbol, ts, round(equity, 6) AS equity FROM q")
def equity_curve(spark, sf_dir):
    return B.equity(bounded(spark, sf_dir)).select("symbol", "ts", "equity")


@query(_EQ + f" SELECT symbol, ts, round(equity / max(equity) OVER {_RUN} - 1, 6) AS drawdown FROM q")
def drawdown(spark, sf_dir):
    return B.drawdown(B.equity(bounded(spark, sf_dir))).select("symbol", "ts", "drawdown")


@query(f"{_R}, f AS (SELECT symbol, product(1 + r) OVER {_frame(96)} - 1 AS c FROM x) SELECT symbol, round(min(c), 6) AS worst_96 FROM f GROUP BY 1")
def worst_rolling(spark, sf_dir):
    return B.worst_rolling(bounded(spark, sf_dir), 96)


_POS = f"{_R}, s AS (SELECT *, CAST(p >= 0.6 AS INT) AS signal FROM x), o AS (SELECT *, coalesce(lag(signal) OVER {_W}, 0) AS position FROM s)"


def _positioned(spark, sf_dir) -> DataFrame:
    x = bounded(spark, sf_dir)
    return x.withColumn("position", B.delayed((F.col("p") >= 0.6).cast("int"), C.series(), 0).cast("int"))


@query(_POS + " SELECT symbol, ts, position FROM o")
def signal_delay(spark, sf_dir):
    return _positioned(spark, sf_dir).select("symbol", "ts", "position")


@query(_POS + f", c AS (SELECT symbol, ts, coalesce(abs(position - lag(position) OVER {_W}), position) AS changed FROM o) SELECT symbol, ts, CAST(changed AS INT) AS changed FROM c")
def position_changes(spark, sf_dir):
    return _positioned(spark, sf_dir).select("symbol", "ts", B.change(F.col("position"), C.series(), F.col("position")).cast("int").alias("changed"))


_TRADES = _POS + f", m AS (SELECT *, CAST(position = 1 AND coalesce(lag(position) OVER {_W}, 0) <> 1 AS INT) AS s FROM o), i AS (SELECT *, CAST(sum(s) OVER {_RUN} AS BIGINT) AS trade_id FROM m)"


@query(_TRADES + " SELECT symbol, trade_id, min(ts) AS entry_ts, count(*) AS n_bars, round(product(1 + r) - 1, 6) AS trade_return FROM i WHERE position = 1 GROUP BY 1, 2")
def trade_segments(spark, sf_dir):
    return B.trades(_positioned(spark, sf_dir), r="r")


_TH = f"""{_R}, h AS (SELECT x.*, t.threshold FROM x, (SELECT unnest([0.55, 0.60, 0.65, 0.70, 0.75])::DOUBLE AS threshold) t),
 o AS (SELECT *, coalesce(lag(CAST(p >= threshold AS INT)) OVER (PARTITION BY symbol, threshold ORDER BY ts), 0) AS position FROM h),
 c AS (SELECT *, coalesce(abs(position - lag(position) OVER (PARTITION BY symbol, threshold ORDER BY ts)), position) AS trade, coalesce(lag(position) OVER (PARTITION BY symbol, threshold ORDER BY ts), 0) AS before FROM o),
 s AS (SELECT *, position * r - trade * 0.0006 AS sr, sum(CAST(position = 1 AND before <> 1 AS INT)) OVER (PARTITION BY symbol, threshold ORDER BY ts ROWS UNBOUNDED PRECEDING) AS tid FROM c),
 e2 AS (SELECT *, product(1 + sr) OVER (PARTITION BY symbol, threshold ORDER BY ts ROWS UNBOUNDED PRECEDING) AS equity FROM s),
 d AS (SELECT *, equity / max(equity) OVER (PARTITION BY symbol, threshold ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e2),
 base AS (SELECT symbol, threshold, product(1 + sr) - 1 AS total_return, product(1 + r) - 1 AS buy_and_hold_return, min(dd) AS max_drawdown, CAST(sum(trade) AS BIGINT) AS number_of_trades FROM d GROUP BY 1, 2),
 tr AS (SELECT symbol, threshold, tid, product(1 + position * r) - 1 AS t FROM s WHERE position = 1 GROUP BY 1, 2, 3),
 per AS (SELECT symbol, threshold, count(*) AS completed_trades, count(*) FILTER (t > 0) AS won, avg(t) FILTER (t > 0) AS aw, avg(t) FILTER (t < 0) AS al, avg(t) AS ev, coalesce(sum(t) FILTER (t > 0), 0) AS profit, coalesce(abs(sum(t) FILTER (t < 0)), 0) AS loss FROM tr GROUP BY 1, 2),
 th AS (SELECT base.symbol, base.threshold, round(total_return, 6) AS total_return, round(buy_and_hold_return, 6) AS buy_and_hold_return, round(max_drawdown, 6) AS max_drawdown, number_of_trades, coalesce(completed_trades, 0) AS completed_trades,
 round(coalesce(won / nullif(completed_trades, 0), 0), 6) AS win_rate, round(coalesce(aw, 0), 6) AS average_win, round(coalesce(al, 0), 6) AS average_loss, round(coalesce(ev, 0), 6) AS expected_value_per_trade,
 round(CASE WHEN loss > 0 THEN profit / loss WHEN profit > 0 THEN 'infinity'::DOUBLE ELSE 0 END, 6) AS profit_factor FROM base LEFT JOIN per ON base.symbol = per.symbol AND base.threshold = per.threshold)"""
_TH_COLUMNS = ["symbol", "threshold", "total_return", "buy_and_hold_return", "max_drawdown", "number_of_trades", "completed_trades", "win_rate", "average_win", "average_loss", "expected_value_per_trade", "profit_factor"]


@query(f"{_TH} SELECT {', '.join(_TH_COLUMNS)} FROM th")
def threshold_backtest(spark, sf_dir):
    return B.threshold_backtest(bounded(spark, sf_dir), "p", "r").select(*_TH_COLUMNS)


@query(f"{_TH} SELECT symbol, threshold, total_return FROM th QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY total_return DESC, max_drawdown DESC, least(profit_factor, 1e6) DESC, threshold) = 1")
def best_threshold(spark, sf_dir):
    return B.best_threshold(rounded(B.threshold_backtest(bounded(spark, sf_dir), "p", "r"))).select("symbol", "threshold", "total_return")


def _risk_rows(spark, sf_dir) -> DataFrame:
    flags = {"target_volatility_high_next_4": F.col("volume") >= 100, "target_drop_next_4": F.col("r") < -0.002, "target_big_move_next_4": F.abs("r") > 0.003}
    return bounded(spark, sf_dir).withColumns({k: v.cast("int") for k, v in flags.items()})


_PW = "(PARTITION BY symbol, strategy, threshold ORDER BY ts)"
_PR = "(PARTITION BY symbol, strategy, threshold ORDER BY ts ROWS UNBOUNDED PRECEDING)"
_RISK = f"""{_R}, h AS (SELECT x.*, volume >= 100 AS hv, r < -0.002 AS dp, abs(r) > 0.003 AS bm, s.strategy, s.exposure, t.threshold FROM x, (SELECT unnest(['cash', 'half']) AS strategy, unnest([0.0, 0.5])::DOUBLE AS exposure) s, (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7, 0.8])::DOUBLE AS threshold) t),
 o AS (SELECT *, coalesce(lag(CASE WHEN p >= threshold THEN exposure ELSE 1.0 END) OVER {_PW}, 1.0) AS position FROM h), c AS (SELECT *, coalesce(abs(position - lag(position) OVER {_PW}), 0) AS changed FROM o),
 s AS (SELECT *, position * r - changed * 0.0006 AS sr FROM c), e2 AS (SELECT *, product(1 + sr) OVER {_PR} AS equity, product(1 + r) OVER {_PR} AS bh, product(1 + sr) OVER (PARTITION BY symbol, strategy, threshold ORDER BY ts ROWS 95 PRECEDING) - 1 AS w1, product(1 + sr) OVER (PARTITION BY symbol, strategy, threshold ORDER BY ts ROWS 671 PRECEDING) - 1 AS w7 FROM s),
 d AS (SELECT *, equity / max(equity) OVER {_PR} - 1 AS dd, bh / max(bh) OVER {_PR} - 1 AS bdd FROM e2),
 k AS (SELECT symbol, strategy, threshold, count(*) AS n, product(1 + sr) - 1 AS total_return, product(1 + r) - 1 AS buy_and_hold_return, min(dd) AS max_drawdown, min(bdd) AS buy_and_hold_max_drawdown, stddev_pop(sr) * sqrt(35040) AS annualized_volatility, avg(position) AS exposure_ratio, avg(CAST(position < 1 AS INT)) AS risk_off_ratio,
 count(*) FILTER (changed > 0) AS number_of_position_changes, sum(changed * 0.0006) AS total_fee_paid, min(w1) AS worst_1d_return, min(w7) AS worst_7d_return, count(*) FILTER (position < 1) AS off, count(*) FILTER (hv) AS nhv, count(*) FILTER (dp) AS ndp, count(*) FILTER (bm) AS nbm,
 count(*) FILTER (hv AND position < 1) AS ohv, count(*) FILTER (dp AND position < 1) AS odp, count(*) FILTER (bm AND position < 1) AS obm FROM d GROUP BY 1, 2, 3)"""
_RISK_COLUMNS = {
    "total_return": "total_return", "buy_and_hold_return": "buy_and_hold_return", "excess_return_vs_bh": "total_return - buy_and_hold_return", "max_drawdown": "max_drawdown", "buy_and_hold_max_drawdown": "buy_and_hold_max_drawdown", "mdd_improvement": "max_drawdown - buy_and_hold_max_drawdown",
    "annualized_volatility": "annualized_volatility", "exposure_ratio": "exposure_ratio", "average_position": "exposure_ratio", "risk_off_ratio": "risk_off_ratio", "total_fee_paid": "total_fee_paid", "worst_1d_return": "worst_1d_return", "worst_7d_return": "worst_7d_return",
    "avoided_high_vol_ratio": "coalesce(ohv / nullif(nhv, 0), 0)", "missed_high_vol_ratio": "coalesce((nhv - ohv) / nullif(nhv, 0), 0)", "risk_off_precision": "coalesce(ohv / nullif(off, 0), 0)", "risk_off_recall": "coalesce(ohv / nullif(nhv, 0), 0)", "avoided_drop_ratio": "coalesce(odp / nullif(ndp, 0), 0)", "risk_off_during_big_move_ratio": "coalesce(obm / nullif(nbm, 0), 0)",
}


@query(f"{_RISK} SELECT symbol, strategy, threshold, number_of_position_changes, {', '.join(f'round({v}, 6) AS {k}' for k, v in _RISK_COLUMNS.items())} FROM k")
def risk_filter_sweep(spark, sf_dir):
    return B.risk_filter_sweep(_risk_rows(spark, sf_dir), "p", "r").select("symbol", "strategy", "threshold", "number_of_position_changes", *_RISK_COLUMNS)


@query(f"{_R}, t AS (SELECT symbol, count(*) AS n, product(1 + r / 50) - 1 AS t, stddev_pop(r / 50) * sqrt(35040) AS v FROM x GROUP BY 1), a AS (SELECT symbol, CASE WHEN t <= -1 THEN -1 ELSE pow(1 + t, 35040.0 / n) - 1 END AS a, v FROM t) SELECT symbol, round(a, 6) AS annualized_return, round(v, 6) AS annualized_volatility, round(a / nullif(v, 0), 6) AS sharpe_like FROM a")
def annualised(spark, sf_dir):
    small = F.col("r") / 50
    t = bounded(spark, sf_dir).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), (F.product(1 + small) - 1).alias("t"), (F.stddev_pop(small) * F.sqrt(F.lit(float(C.BARS_A_YEAR)))).alias("annualized_volatility"))
    t = t.withColumn("annualized_return", C.annualised_return(F.col("t"), F.col("n")))
    return t.select("symbol", "annualized_return", "annualized_volatility", F.try_divide("annualized_return", "annualized_volatility").alias("sharpe_like"))


_FW = "(PARTITION BY symbol, filter_name ORDER BY ts)"
_FR = "(PARTITION BY symbol, filter_name ORDER BY ts ROWS UNBOUNDED PRECEDING)"


@query(
    f"""{_R}, h AS (SELECT x.*, f.* FROM x, (SELECT unnest(['hv040_drop007', 'hv050_drop010', 'hv060_drop015']) AS filter_name, unnest([0.4, 0.5, 0.6])::DOUBLE AS threshold_high_vol, unnest([0.07, 0.10, 0.15])::DOUBLE AS threshold_drop) f),
 o AS (SELECT *, coalesce(lag(CAST(NOT (p >= threshold_high_vol OR volume / 1000 >= threshold_drop) AS DOUBLE)) OVER {_FW}, 1.0) AS position FROM h), c AS (SELECT *, coalesce(abs(position - lag(position) OVER {_FW}), 0) AS changed FROM o), s AS (SELECT *, position * r - changed * 0.0006 AS sr FROM c),
 e2 AS (SELECT *, product(1 + sr) OVER {_FR} AS equity, product(1 + r) OVER {_FR} AS bh FROM s), d AS (SELECT *, equity / max(equity) OVER {_FR} - 1 AS dd, bh / max(bh) OVER {_FR} - 1 AS bdd FROM e2)
 SELECT symbol, filter_name, threshold_high_vol, threshold_drop, round(product(1 + sr) - 1, 6) AS total_return, round(product(1 + r) - 1, 6) AS buy_and_hold_return, round(min(dd), 6) AS max_drawdown, round(min(bdd), 6) AS buy_and_hold_max_drawdown, round(avg(position), 6) AS exposure_ratio, round(avg(CAST(position < 1 AS INT)), 6) AS risk_off_ratio,
 count(*) FILTER (changed > 0) AS number_of_position_changes, round(sum(changed) * 0.0006, 6) AS total_fee_paid, round(avg(r) FILTER (position >= 1), 6) AS avg_return_when_risk_on, round(avg(r) FILTER (position < 1), 6) AS avg_return_when_risk_off, round(avg(CAST(volume >= 100 AS INT)) FILTER (position < 1), 6) AS actual_high_vol_rate_when_risk_off, round(avg(CAST(r < 0 AS INT)) FILTER (position < 1), 6) AS actual_drop_rate_when_risk_off FROM d GROUP BY 1, 2, 3, 4"""
)
def similarity_filters(spark, sf_dir):
    x = bounded(spark, sf_dir).withColumns({"similar_high_vol_ratio": F.col("p"), "similar_drop_ratio": F.col("volume") / 1000, "actual_high_vol": (F.col("volume") >= 100).cast("int"), "actual_drop": (F.col("r") < 0).cast("int"), "actual_return_next_4": F.col("r")})
    return B.similarity_filters(x)


# --- simulation ---


def _simulator_rows(x: DataFrame) -> DataFrame:
    flat = x.select("symbol", "ts", (F.col("r") * 2).alias("y_pred"), (100 + F.col("p")).alias("close"), (100 + F.col("p") + F.col("volume") / 100).alias("high"), (100 + F.col("p") - F.col("volume") / 150).alias("low"))
    return simulate.next_bar_view(flat)


def _simulated(spark, sf_dir) -> DataFrame:
    return simulate.simulate(_simulator_rows(bounded(spark, sf_dir)))


_SIM = f"""WITH RECURSIVE {_R[5:]}, v AS (SELECT symbol, ts, r * 2 AS pred, 100 + p AS close, lead(100 + p + volume / 100) OVER {_W} AS nh, lead(100 + p - volume / 150) OVER {_W} AS nl, lead(100 + p) OVER {_W} AS nc FROM x),
 n AS (SELECT *, row_number() OVER {_W} AS rn FROM v WHERE nc IS NOT NULL),
 f AS (SELECT symbol, CAST(0 AS BIGINT) AS rn, CAST(NULL AS TIMESTAMP) AS ts, 0 AS side, CAST(NULL AS DOUBLE) AS entry, 0 AS wait, CAST(0 AS DOUBLE) AS gross, 0 AS fees, 0 AS moves, 0 AS tp, 0 AS sl, 0 AS te, 0 AS cb FROM (SELECT DISTINCT symbol FROM n)
 UNION ALL SELECT symbol, rn, ts, CASE WHEN sl + tp > 0 THEN 0 ELSE s2 END, CASE WHEN sl + tp > 0 OR s2 = 0 THEN NULL ELSE e2 END, CASE WHEN sl + tp > 0 THEN 4 WHEN wait > 0 AND s2 = 0 THEN wait - 1 ELSE wait END,
 CASE WHEN sl = 1 THEN -0.008 WHEN tp = 1 THEN 0.015 WHEN s2 <> 0 THEN s2 * (nc / close - 1) ELSE 0 END, fees + sl + tp, moves + sl + tp, tp, sl, te, cb FROM (
 SELECT *, CASE WHEN s2 <> 0 AND sl = 0 AND s2 * ((CASE WHEN s2 > 0 THEN nh ELSE nl END) - e2 * (1 + s2 * 0.015)) >= 0 THEN 1 ELSE 0 END AS tp FROM (
 SELECT *, CASE WHEN s2 <> 0 AND s2 * ((CASE WHEN s2 > 0 THEN nl ELSE nh END) - e2 * (1 - s2 * 0.008)) <= 0 THEN 1 ELSE 0 END AS sl FROM (
 SELECT *, CASE WHEN s1 = 0 AND wait = 0 AND abs(pred) > 0.005 THEN CAST(sign(pred) AS INT) ELSE s1 END AS s2, CASE WHEN s1 = 0 AND wait = 0 AND abs(pred) > 0.005 THEN close ELSE e1 END AS e2, f1 + CASE WHEN s1 = 0 AND wait = 0 AND abs(pred) > 0.005 THEN 1 ELSE 0 END AS fees, m1 + CASE WHEN s1 = 0 AND wait = 0 AND abs(pred) > 0.005 THEN 1 ELSE 0 END AS moves, CASE WHEN s1 = 0 AND wait > 0 THEN 1 ELSE 0 END AS cb FROM (
 SELECT n.*, f.wait, CASE WHEN f.side <> 0 AND -f.side * n.pred > 0.005 THEN -f.side WHEN f.side <> 0 AND -f.side * n.pred > 0.001 THEN 0 ELSE f.side END AS s1, CASE WHEN f.side <> 0 AND -f.side * n.pred > 0.005 THEN n.close WHEN f.side <> 0 AND -f.side * n.pred > 0.001 THEN NULL ELSE f.entry END AS e1,
 CASE WHEN f.side <> 0 AND -f.side * n.pred > 0.005 THEN 2 WHEN f.side <> 0 AND -f.side * n.pred > 0.001 THEN 1 ELSE 0 END AS f1, CASE WHEN f.side <> 0 AND -f.side * n.pred > 0.001 THEN 1 ELSE 0 END AS m1, CASE WHEN f.side <> 0 AND -f.side * n.pred > 0.001 THEN 1 ELSE 0 END AS te FROM f JOIN n ON f.symbol = n.symbol AND n.rn = f.rn + 1)))))"""


_STATES = " SELECT symbol, ts, CAST(side AS INT) AS position, round(gross, 6) + 0.0 AS gross_return, round(gross - fees * 0.0005, 6) + 0.0 AS net_return, CAST(fees AS INT) AS fee_events, CAST(moves AS INT) AS position_change, CAST(tp AS INT) AS take_profit_exit, CAST(sl AS INT) AS stop_loss_exit, CAST(te AS INT) AS threshold_exit, CAST(cb AS INT) AS cooldown_blocked, CAST(wait AS INT) AS cooldown_remaining FROM f WHERE rn > 0"


def _state_columns(rows: DataFrame) -> DataFrame:
    # rounded as in the SQL; adding zero gives both engines one zero
    rounded = [(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("gross_return", "net_return")]
    return rows.select("symbol", "ts", "position", *rounded, "fee_events", "position_change", "take_profit_exit", "stop_loss_exit", "threshold_exit", "cooldown_blocked", "cooldown_remaining")


@query(_SIM + _STATES)
def futures_state_machine(spark, sf_dir):
    return _state_columns(_simulated(spark, sf_dir))


_COUNTED = {"n_fee_events": "fees", "n_position_change": "moves", "n_take_profit_exit": "tp", "n_stop_loss_exit": "sl", "n_threshold_exit": "te", "n_cooldown_blocked": "cb"}


@query(
    f"""{_SIM}, g AS (SELECT f.*, n.nc / n.close - 1 AS held, gross - fees * 0.0005 AS net FROM f JOIN n ON f.symbol = n.symbol AND f.rn = n.rn), c AS (SELECT *, product(1 + held) OVER {_RUN} AS he, product(1 + net) OVER {_RUN} AS se FROM g),
 d AS (SELECT *, he / max(he) OVER {_RUN} - 1 AS hd, se / max(se) OVER {_RUN} - 1 AS sd FROM c) SELECT symbol, round(product(1 + held) - 1, 6) + 0.0 AS buy_hold_total, round(product(1 + gross) - 1, 6) + 0.0 AS gross_total, round(product(1 + net) - 1, 6) + 0.0 AS net_total, round(min(hd), 6) + 0.0 AS buy_hold_mdd, round(min(sd), 6) + 0.0 AS strategy_mdd, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {n}' for n, c in _COUNTED.items())} FROM d GROUP BY 1"""
)
def simulation_summary(spark, sf_dir):
    totals = [(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("buy_hold_total", "gross_total", "net_total", "buy_hold_mdd", "strategy_mdd")]
    return simulate.simulation_summary(_simulated(spark, sf_dir)).select("symbol", *totals, *_COUNTED)


@query(f"SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN -1 ELSE 0 END AS position FROM orders")
def position_number(spark, sf_dir):
    named = F.when(F.col("o_orderstatus") == "O", "Long").when(F.col("o_orderstatus") == "F", "Short").otherwise("Cash")
    return _table(spark, sf_dir, "orders").select("o_orderkey", C.position_number(named).alias("position"))


@query(f"{_R}, s AS (SELECT symbol, ts, CAST(r > 0 AS INT) AS l FROM x), c AS (SELECT symbol, abs(l - coalesce(lag(l) OVER {_W}, 0)) AS c FROM s) SELECT symbol, CAST(sum(c) AS BIGINT) AS n_changes FROM c GROUP BY 1")
def zero_threshold_changes(spark, sf_dir):
    return B.zero_threshold_changes(bounded(spark, sf_dir), "r")


# --- metrics and models ---

_SCORED = "WITH s AS (SELECT l.quality AS y, least(greatest(d.n_chars / 5000.0, 0.01), 0.99) AS p FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def _scored(spark, sf_dir) -> DataFrame:
    d = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id")
    return d.select(F.col("quality").alias("y"), F.least(F.greatest(F.col("n_chars") / 5000.0, F.lit(0.01)), F.lit(0.99)).alias("p"))


def _confusion_sql(thresholds: str) -> str:
    return f"""{_SCORED}, t AS (SELECT s.*, t.threshold FROM s, (SELECT unnest([{thresholds}])::DOUBLE AS threshold) t), k AS (SELECT threshold, count(*) FILTER (y = 1 AND p >= threshold) AS tp, count(*) FILTER (y <> 1 AND p >= threshold) AS fp, count(*) FILTER (y = 1 AND p < threshold) AS fn, count(*) FILTER (y <> 1 AND p < threshold) AS tn FROM t GROUP BY 1),
 m AS (SELECT *, (tp + tn) / (tp + tn + fp + fn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS re FROM k) SELECT threshold, tp, fp, fn, tn, round(accuracy, 6) AS accuracy, round(pr, 6) AS precision, round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1 FROM m"""


@query(_confusion_sql("0.5"))
def confusion(spark, sf_dir):
    return metrics.confusion(_scored(spark, sf_dir), "y", "p")


@query(_confusion_sql("0.3, 0.4, 0.5, 0.6, 0.7, 0.8"))
def threshold_sweep(spark, sf_dir):
    return metrics.confusion(_scored(spark, sf_dir), "y", "p", [0.3, 0.4, 0.5, 0.6, 0.7, 0.8])


@query(_confusion_sql(", ".join(map(str, metrics.DROP_THRESHOLDS))).rpartition(" SELECT threshold")[0] + " SELECT threshold, tp + fp AS n_alarms, round(coalesce((tp + fp) / nullif(tp + fp + fn + tn, 0), 0), 6) AS alarm_ratio, round(pr, 6) AS precision, round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1, tp AS n_caught, fp AS n_false_alarms FROM m")
def threshold_sweep_drop(spark, sf_dir):
    return metrics.alarms(_scored(spark, sf_dir), "y", "p")


@query(f"{_R} SELECT round(avg(CAST(r > 0.005 AS INT)), 6) AS share_0, round(avg(CAST(r < -0.005 AS INT)), 6) AS share_1 FROM x")
def exceedance(spark, sf_dir):
    return models.exceedance(bounded(spark, sf_dir), "r")


@query(_SCORED + ", k AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS r FROM s) SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0), 6) AS roc_auc FROM k")
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(_scored(spark, sf_dir), "y", "p")


@query(_SCORED + ", d AS (SELECT p, count(*) FILTER (y = 1) AS k, count(*) AS n FROM s GROUP BY 1), c AS (SELECT k, sum(k) OVER (ORDER BY p DESC) AS ck, sum(n) OVER (ORDER BY p DESC) AS cn FROM d) SELECT round(sum(k * ck / cn) / sum(k), 6) AS average_precision FROM c")
def average_precision(spark, sf_dir):
    return metrics.average_precision(_scored(spark, sf_dir), "y", "p")


@query(_SCORED + " SELECT round(avg(CASE WHEN y = 1 THEN -ln(p) ELSE -ln(1 - p) END), 6) AS log_loss FROM s")
def log_loss(spark, sf_dir):
    return metrics.log_loss(_scored(spark, sf_dir), "y", "p")


@query(f"{_R}, y AS (SELECT r AS a, lag(r) OVER {_W} AS b FROM x), z AS (SELECT * FROM y WHERE b IS NOT NULL) SELECT round(avg(abs(a - b)), 6) AS mae, round(sqrt(avg((a - b) * (a - b))), 6) AS rmse, round(1 - sum((a - b) * (a - b)) / nullif(var_pop(a) * count(*), 0), 6) AS r2, round(100 * avg(CAST((a >= 0) = (b >= 0) AS INT)), 6) AS direction_accuracy FROM z")
def regression_metrics(spark, sf_dir):
    x = bounded(spark, sf_dir).withColumn("b", F.lag("r").over(C.series())).where("b IS NOT NULL")
    return metrics.regression(x, "r", "b")


def model_features() -> list[str]:
    """The sixteen features of a bar and five of each longer timeframe."""
    return [*indicators.MAIN_FEATURES, *[f"{p}_{c}" for p in ("h1", "h4") for c in indicators.AUX_FEATURES]]


def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows of quarter hours with all features of three timeframes, split in order of time; written once for fit and predictions."""
    rows = labels.next_bar(indicators.main_features(bars(spark, sf_dir, "15 minutes")))
    for prefix, duration in (("h1", "1 hour"), ("h4", "4 hours")):
        rows = joins.asof_join(rows, indicators.aux_features(bars(spark, sf_dir, duration), prefix, duration))
    return stored(split.split_three(labels.risk_labels(rows)), "models")


def _predicted(spark, sf_dir, label: str, settings: models.Settings, negative: str, positive: str, *others: str) -> DataFrame:
    rows = model_rows(spark, sf_dir)
    model = models.fit_classifier(rows.where("split = 'train'"), model_features(), label, settings)
    return models.predict_classes(model, rows.where("split = 'test'"), negative, positive).select("symbol", "ts", label, *others, negative, positive, "pred_label")


@query()
def gbt_classify(spark, sf_dir):
    """High-volatility model: probabilities on the test split."""
    return _predicted(spark, sf_dir, "target_volatility_high_next_4", models.HIGH_VOLATILITY, "pred_proba_low_vol", "pred_proba_high_vol")


@query()
def gbt_direction(spark, sf_dir):
    """Direction model: probabilities on the test split."""
    return _predicted(spark, sf_dir, "target_up_next", models.DIRECTION, "pred_proba_down", "pred_proba_up", "target_return_next")


@query()
def gbt_drop(spark, sf_dir):
    """Drop-risk model: probabilities on the test split."""
    return _predicted(spark, sf_dir, "target_drop_next_4", models.DROP, "pred_proba_no_drop", "pred_proba_drop", "target_return_next_4", "target_volatility_high_next_4", "target_big_move_next_4", "target_return_next", "target_up_next")


@query()
def gbt_regress(spark, sf_dir):
    """Return model: predictions on the test split."""
    rows = model_rows(spark, sf_dir)
    model = models.fit_regressor(rows.where("split = 'train'"), model_features(), "target_return_next", models.DAY_RETURN)
    return models.predict_values(model, rows.where("split = 'test'")).select("symbol", "ts", "target_return_next", "y_pred")


@query()
def feature_importance(spark, sf_dir):
    """The ten features that gain most in the direction model."""
    model = models.fit_classifier(model_rows(spark, sf_dir).where("split = 'train'"), model_features(), "target_up_next", models.DIRECTION)
    return models.importance(spark, model, 10)


_MAIN = [f"return_{k}" for k in (1, 3, 5, 10)] + [f"ma_{n}" for n in (20, 60, 120)] + [f"ma_distance_{n}" for n in (20, 60)] + [f"volatility_{n}" for n in (20, 60)] + ["rsi_14", "volume_change_1", "volume_ma_20", "high_low_range", "close_open_return"]
_BAR = ["open", "high", "low", "close", "volume", "turnover"]
_FULL_PLAIN = ["symbol", "ts", "target_up_next", "h4_trend", *[f"target_{x}_next_4" for x in ("big_move", "drop", "pump", "volatility_high")]]
_FULL_ROUNDED = [*_BAR, *_MAIN, "target_return_next", *[f"h4_{c}" for c in ("return_1", "ma_20", "ma_60", "ma_distance_20")], "target_return_next_4", "target_volatility_next_4", "target_abs_return_next_4"]
_FULL = f"""{_B}, s AS (SELECT symbol, ts, close, {_pct('close', 1)} AS r1 FROM b), {_horizon_sql(4, 0.01)}, {_aux_sql('4 hours', 'h4', 'c')}, {_RSI},
 m1 AS (SELECT *, {', '.join(f'{_pct("close", k)} AS return_{k}' for k in (1, 3, 5, 10))}, {', '.join(f'{_rolled("avg", "close", n)} AS ma_{n}' for n in (20, 60, 120))}, {_pct('volume', 1)} AS volume_change_1, {_rolled('avg', 'volume', 20)} AS volume_ma_20,
  (high - low) / nullif(close, 0) AS high_low_range, close / nullif(open, 0) - 1 AS close_open_return, lead(close) OVER {_W} / nullif(close, 0) - 1 AS target_return_next FROM b),
 m2 AS (SELECT *, {', '.join(f'{_rolled("stddev_samp", "return_1", n)} AS volatility_{n}, close / nullif(ma_{n}, 0) - 1 AS ma_distance_{n}' for n in (20, 60))}, CAST(target_return_next > 0 AS INT) AS target_up_next FROM m1),
 m3 AS (SELECT m2.*, CASE WHEN a.u IS NULL THEN NULL WHEN a.l = 0 AND a.u = 0 THEN 50 WHEN a.l = 0 THEN 100 ELSE 100 - 100 / (1 + a.u / a.l) END AS rsi_14 FROM m2 JOIN a ON m2.symbol = a.symbol AND m2.ts = a.ts),
 m4 AS (SELECT m3.*, c.* EXCLUDE (symbol, ts) FROM m3 ASOF LEFT JOIN c ON m3.symbol = c.symbol AND m3.ts >= c.ts),
 m5 AS (SELECT m4.*, l4.* EXCLUDE (symbol, ts) FROM m4 JOIN l4 ON m4.symbol = l4.symbol AND m4.ts = l4.ts)"""


@query(f"{_FULL} SELECT {', '.join(_FULL_PLAIN)}, {', '.join(f'round({c}, 6) AS {c}' for c in _FULL_ROUNDED)} FROM m5 WHERE {' AND '.join(f'{c} IS NOT NULL' for c in [*_FULL_ROUNDED, 'h4_trend'])}")
def full_features(spark, sf_dir):
    """Cleaned, labelled rows of two timeframes: the whole chain in one plan."""
    main = labels.next_bar(indicators.main_features(bars(spark, sf_dir)))
    rows = joins.asof_join(main, indicators.aux_features(bars(spark, sf_dir, "4 hours"), "h4", "4 hours"))
    return labels.risk_labels(rows)


# --- walk-forward over windows of all features ---

_LENGTHS = {16: 4, 48: 8}
_SCALED = [f"(({c}) - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS z_{i}" for i, c in enumerate(_MAIN)]


def _windows_sql(length: int, step: int) -> str:
    """As ``_WALK``, with vectors of all features' z-scores over ``length`` rows, 20 similar windows, at most 3,000 evaluations a series."""
    vec = " || ".join(f"list(CAST(z_{i} AS FLOAT)) OVER {_frame(length)}" for i in range(len(_MAIN)))
    whole = " AND ".join(f"{c} IS NOT NULL" for c in [*_BAR, *_MAIN, "target_return_next", "target_return_next_4", "target_volatility_next_4"])
    base = _FULL.partition(", m4 AS")[0]
    out = ", ".join(_OUTCOMES)
    return f"""{base}, o AS (SELECT *, {", ".join(_SCALED)} FROM (SELECT m3.*, l4.* EXCLUDE (symbol, ts) FROM m3 JOIN l4 ON m3.symbol = l4.symbol AND m3.ts = l4.ts WHERE {whole})),
 w AS (SELECT symbol, ts, {out}, lag(ts, {length - 1}) OVER {_W} AS window_start_ts, {vec} AS vec FROM o QUALIFY row_number() OVER {_W} >= {length}),
 k AS (SELECT *, row_number() OVER {_W} AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM w),
 ev AS (SELECT * FROM k WHERE rn - 1 >= floor(n * 0.3e0) AND (rn - 1 - floor(n * 0.3e0)) % {step} = 0 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 3000),
 m AS (SELECT a.symbol, a.window_start_ts AS eval_window_start_ts, a.ts AS eval_window_end_ts, {", ".join(f"a.{c} AS a_{c}" for c, (_, n) in _OUTCOMES.items() if n)}, {", ".join(f"b.{c}" for c in _OUTCOMES)}, list_cosine_similarity(a.vec::DOUBLE[], b.vec::DOUBLE[]) AS sim, b.ts AS bts,
  count(*) OVER (PARTITION BY a.symbol, a.ts) AS candidate_count FROM ev a JOIN w b ON a.symbol = b.symbol AND b.ts < a.ts - INTERVAL 1 DAY),
 t AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY symbol, eval_window_end_ts ORDER BY round(sim, 9) DESC, bts) <= 20),
 wf AS (SELECT symbol, eval_window_start_ts, eval_window_end_ts, {length} AS pattern_length, candidate_count, 20 AS top_k, avg(sim) AS mean_similarity, min(sim) AS min_similarity, max(sim) AS max_similarity, {", ".join(f"avg({c}) AS {n}" for c, (n, _) in _OUTCOMES.items())}, {", ".join(f"max(a_{c}) AS {n}" for c, (_, n) in _OUTCOMES.items() if n)} FROM t GROUP BY ALL HAVING count(*) = 20)
 SELECT {", ".join(_WALK_PLAIN)}, {", ".join(f"round({c}, 6) AS {c}" for c in _WALK_ROUNDED)} FROM wf"""


def walk_windows(spark: SparkSession, sf_dir: str, length: int, step: int) -> tuple[DataFrame, DataFrame]:
    """Windows of all features' z-scores and those of them that are evaluated."""
    rows = stored(labels.risk_labels(labels.next_bar(indicators.main_features(bars(spark, sf_dir)))), "walk")
    scaled = patterns.scale(rows, patterns.fit_scaler(rows, _MAIN))
    windows = patterns.pattern_vectors(scaled, _MAIN, length, list(_OUTCOMES))
    return windows, split.step_sample(windows.withColumn("ts", F.col("window_end_ts")), step, 3_000).drop("ts")


for _length, _step in _LENGTHS.items():
    query(_windows_sql(_length, _step), f"walk_forward_{_length}")(lambda spark, sf_dir, n=_length, s=_step: similarity.walk_forward(*walk_windows(spark, sf_dir, n, s), 20, "INTERVAL 1 DAY"))


# --- one series over many tasks: all events as one symbol ---

#: Rows of a chunk in these queries, few enough for the smallest tables to have several.
_CHUNK = 200


def _one(sql: str) -> str:
    return sql.replace("event_type AS symbol", "'ALL' AS symbol")


@query(_one(f"{_FULL} SELECT symbol, ts, {', '.join(f'round({c}, 6) AS {c}' for c in _MAIN)} FROM m3"))
def long_series_features(spark, sf_dir):
    """The features of one long series in chunks with halos."""
    return ranges.halo(bars(spark, sf_dir, one=True), indicators.main_features, 120, rows=_CHUNK).select("symbol", "ts", *_MAIN)


def _patterns_sql(n: int) -> str:
    stats = ", ".join(f"{a}(p) OVER {_frame(n)} AS p_{x}" for x, a in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")))
    return _one(
        f"{_R}, w AS (SELECT symbol, lag(ts, {n - 1}) OVER {_W} AS window_start_ts, ts AS window_end_ts, row_number() OVER {_W} AS rn, {stats}, p AS p_last, lag(p, {n - 1}) OVER {_W} AS p_first FROM x)"
        f" SELECT symbol, window_start_ts, window_end_ts, CAST({n} AS INT) AS pattern_length, {', '.join(f'round(p_{x}, 6) AS p_{x}' for x in ('mean', 'std', 'min', 'max', 'last', 'first'))}, round(p_last - p_first, 6) AS p_change FROM w WHERE rn >= {n}"
    )


#: Window summaries of one long series in chunks with halos, by number of rows.
for _length in patterns.LENGTHS:
    query(_patterns_sql(_length), f"long_series_patterns_{_length}")(
        lambda spark, sf_dir, n=_length: ranges.halo(bounded(spark, sf_dir, one=True), lambda df: patterns.pattern_summary(df, ["p"], n), n, rows=_CHUNK, out_time="window_end_ts")
    )


@query(_one(_EQ + f" SELECT symbol, ts, round(equity, 6) AS equity, round(equity / max(equity) OVER {_RUN} - 1, 6) AS drawdown FROM q"))
def long_series_equity(spark, sf_dir):
    """Growth and drawdown of one long series by scans of chunk summaries."""
    chunks = ranges.chunked(bounded(spark, sf_dir, one=True), rows=_CHUNK)
    return ranges.drawdown_scan(ranges.equity_scan(chunks)).select("symbol", "ts", "equity", "drawdown")


@query(_one(_TRADES + " SELECT symbol, trade_id, min(ts) AS entry_ts, count(*) AS n_bars, round(product(1 + r) - 1, 6) AS trade_return FROM i WHERE position = 1 GROUP BY 1, 2"))
def long_series_trades(spark, sf_dir):
    """Trades of one long series; the signal's delay by a halo of one row, the runs by scans."""
    delayed = lambda df: df.withColumn("position", B.delayed((F.col("p") >= 0.6).cast("int"), C.series(), 0).cast("int"))
    return ranges.trades_scan(ranges.chunked(ranges.halo(bounded(spark, sf_dir, one=True), delayed, 1, rows=_CHUNK), rows=_CHUNK), r="r")


@query(_one(f"{_E}, {_bars_sql('15 minutes')}, {_aux_sql('1 hour', 'h1', 'a')}, {_aux_sql('4 hours', 'h4', 'c')} SELECT b.symbol, b.ts, round(b.close, 6) AS close, {_aux_columns('h1')}, {_aux_columns('h4')} FROM b ASOF LEFT JOIN a ON b.symbol = a.symbol AND b.ts >= a.ts ASOF LEFT JOIN c ON b.symbol = c.symbol AND b.ts >= c.ts WHERE a.ts IS NOT NULL AND c.ts IS NOT NULL"))
def long_series_asof(spark, sf_dir):
    """Two longer timeframes as of each bar of one long series, merged in chunks."""
    out = bars(spark, sf_dir, "15 minutes", one=True).select("symbol", "ts", "close")
    for prefix, duration in (("h1", "1 hour"), ("h4", "4 hours")):
        out = ranges.asof_join_ranges(out, indicators.aux_features(bars(spark, sf_dir, duration, one=True), prefix, duration), rows=_CHUNK)
    return out.where("h1_trend IS NOT NULL AND h4_trend IS NOT NULL")


@query(_one(_SIM + _STATES))
def long_series_state_machine(spark, sf_dir):
    """The state machine on one long series, chunks side by side."""
    return _state_columns(simulate.simulate_ranges(_simulator_rows(bounded(spark, sf_dir, one=True)), rows=_CHUNK))
