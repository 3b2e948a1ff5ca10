"""Long, short or cash simulation with signal exits, stops, targets and a cooldown: a fold over each series."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import series
from ..storage import stored
from .backtest import drawdown, equity
from .ranges import chunked


@dataclass(frozen=True)
class Rules:
    enter: float = 0.005
    leave: float = 0.001
    target: float = 0.015
    stop: float = 0.008
    cooldown: int = 4
    fee: float = 0.0005


SCHEMA = "symbol string, ts timestamp_ntz, starting_position string, position_state string, position int, entry_price double, gross_return double, fee_events int, fee_cost double, net_return double, position_change int, long_entry int, short_entry int, take_profit_exit int, stop_loss_exit int, threshold_exit int, cooldown_blocked int, cooldown_remaining int, action_reason string, bar_return double"


def next_bar_view(bars: DataFrame) -> DataFrame:
    """close, the next row's high, low and close, and the return to it; the last row has no next one and goes."""
    w = series()
    nxt = {f"next_{c}": F.lead(c).over(w) for c in ("high", "low", "close")}
    return bars.withColumns(nxt).withColumn("bar_return", F.try_divide("next_close", "close") - 1).dropna(subset=list(nxt))


_SIDE = {1: "Long", -1: "Short", 0: "Cash"}


def step(side: int, entry: float, wait: int, pred: float, close: float, high: float, low: float, after: float, rules: Rules) -> tuple[int, float, int, dict]:
    """One row: the state after it and what happened. ``side`` is 1, -1 or 0."""
    seen = dict.fromkeys(("fee_events", "position_change", "long_entry", "short_entry", "take_profit_exit", "stop_loss_exit", "threshold_exit", "cooldown_blocked"), 0) | {"gross_return": 0.0, "action_reason": "Hold"}

    def enter(to: int, fees: int, reason: str) -> None:
        nonlocal side, entry
        side, entry = to, close
        seen["fee_events"] += fees
        seen["position_change"] += 1
        seen["long_entry" if to > 0 else "short_entry"] = 1
        seen["action_reason"] = reason

    def leave(reason: str, kind: str) -> None:
        nonlocal side, entry
        side, entry = 0, float("nan")
        seen["fee_events"] += 1
        seen["position_change"] += 1
        seen[kind] = 1
        seen["action_reason"] = reason

    against = -side * pred
    if side and against > rules.enter:
        seen["threshold_exit"] = 1
        enter(-side, 2, f"Reverse {_SIDE[side]} to {_SIDE[-side]}")
    elif side and against > rules.leave:
        leave(f"Threshold Exit {_SIDE[side]}", "threshold_exit")
    if not side:
        if wait:
            seen["cooldown_blocked"], seen["action_reason"] = 1, "Cooldown"
        elif abs(pred) > rules.enter:
            to = 1 if pred > 0 else -1
            enter(to, 1, f"Enter {_SIDE[to]}")
    forced = False
    if side:
        stop, target = entry * (1 - side * rules.stop), entry * (1 + side * rules.target)
        worst, best = (low, high) if side > 0 else (high, low)
        name, forced = _SIDE[side], True
        if side * (worst - stop) <= 0:
            seen["gross_return"] = -rules.stop
            leave(f"Stop Loss {name}", "stop_loss_exit")
        elif side * (best - target) >= 0:
            seen["gross_return"] = rules.target
            leave(f"Take Profit {name}", "take_profit_exit")
        else:
            forced = False
            seen["gross_return"] = side * (after / close - 1)
    if forced:
        wait = rules.cooldown
    elif wait and not side:
        wait -= 1
    return side, entry, wait, seen


def folded(rows: pd.DataFrame, state: tuple[int, float | None, int], rules: Rules) -> pd.DataFrame:
    """Sorted rows of one series from a state on: side, entry price, rows to wait."""
    side, entry, wait = state
    entry, out = float("nan") if entry is None else entry, []
    for r in rows.itertuples(index=False):
        began = _SIDE[side]
        side, entry, wait, seen = step(side, entry, wait, r.y_pred, r.close, r.next_high, r.next_low, r.next_close, rules)
        cost = seen["fee_events"] * rules.fee
        out.append({"symbol": r.symbol, "ts": r.ts, "starting_position": began, "position_state": _SIDE[side], "position": side, "entry_price": None if entry != entry else entry, "fee_cost": cost, "net_return": seen["gross_return"] - cost, "cooldown_remaining": wait, "bar_return": r.bar_return} | seen)
    return pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])


def simulate(df: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Positions and returns row by row, from (symbol, ts, y_pred, close, next_high, next_low, next_close, bar_return).

    A row's state is that after its exits. Stops come before targets. Each symbol is folded in one task, in
    order of time: the state makes rows depend on all before them.
    """
    rules = rules or Rules()

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        return folded(rows.sort_values("ts"), (0, None, 0), rules)

    needed = ["symbol", "ts", "y_pred", "close", "next_high", "next_low", "next_close", "bar_return"]
    return df.select(*needed).dropna().groupBy("symbol").applyInPandas(fold, SCHEMA)


_NEEDED = ("y_pred", "close", "next_high", "next_low", "next_close")
State = tuple[int, float | None, int]


def _after(state: State, row: tuple, rules: Rules) -> State:
    side, entry, wait, _ = step(state[0], float("nan") if state[1] is None else state[1], state[2], *row, rules)
    return side, None if entry != entry else entry, wait


def _end(rows: list[tuple], i: int, state: State, rules: Rules, known: dict) -> State:
    """The state after all rows from the ``i``-th on; runs that fall together with one taken before stop there."""
    passed = []
    while i < len(rows) and (i, state) not in known:
        passed.append((i, state))
        state, i = _after(state, rows[i], rules), i + 1
    state = known.get((i, state), state)
    known.update(dict.fromkeys(passed, state))
    return state


def state_map(rows: list[tuple], rules: Rules) -> dict:
    """What any state ahead of the rows turns into behind them.

    ``cash``: by rows still to wait. ``long`` and ``short``: as the entry price is not known, the rows at which a stop or a
    target could be met first, with the state that follows at the end, and the end of a position that meets none: one that a prediction closes or
    turns, or None where it stays open.
    """
    known: dict = {}
    out: dict = {"cash": [_end(rows, 0, (0, None, w), rules, known) for w in range(rules.cooldown + 1)]}
    for side, name in ((1, "long"), (-1, "short")):
        steps, low, high, end = [], float("inf"), float("-inf"), None
        for i, row in enumerate(rows):
            against = -side * row[0]
            if against > rules.enter or against > rules.leave:
                end = _end(rows, i + 1, _after((side, 1.0, 0), row, rules), rules, known)
                break
            if row[3] < low or row[2] > high:  # only a new extreme can be the first to meet a bound
                low, high = min(low, row[3]), max(high, row[2])
                worst, best = (row[3], row[2]) if side > 0 else (row[2], row[3])
                steps.append((worst, best, _end(rows, i + 1, (0, None, rules.cooldown), rules, known)))
        out[name] = (steps, end)
    return out


def mapped(state: State, found: dict, rules: Rules) -> State:
    """The state behind the rows of a ``state_map``."""
    side, entry, wait = state
    if not side:
        return tuple(found["cash"][wait])
    steps, end = found["long" if side > 0 else "short"]
    stop, target = entry * (1 - side * rules.stop), entry * (1 + side * rules.target)
    for worst, best, then in steps:
        if side * (worst - stop) <= 0 or side * (best - target) >= 0:
            return tuple(then)
    return tuple(end) if end else state


def simulate_ranges(df: DataFrame, rules: Rules | None = None, rows: int | None = None) -> DataFrame:
    """As ``simulate``, with every series cut into chunks that run side by side.

    A first pass gives each chunk's map from states ahead of it to states behind it; the maps, one row for each chunk, are
    composed in order of time; a second pass runs each chunk from its start state. No task holds more than a chunk, or a series' maps.
    """
    rules = rules or Rules()
    chunks = chunked(df.select("symbol", "ts", *_NEEDED, "bar_return").dropna(), rows=rows)

    def maps(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_pos")
        found = state_map(list(part[list(_NEEDED)].itertuples(index=False, name=None)), rules)
        return pd.DataFrame({"symbol": part["symbol"].iloc[:1], "_chunk": part["_chunk"].iloc[:1], "found": [json.dumps(found)]})

    def compose(part: pd.DataFrame) -> pd.DataFrame:
        state, starts = (0, None, 0), []
        part = part.sort_values("_chunk")
        for found in part["found"]:
            starts.append(state)
            state = mapped(state, json.loads(found), rules)
        return part[["symbol", "_chunk"]].assign(side=[s[0] for s in starts], entry=[s[1] for s in starts], wait=[s[2] for s in starts])

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        first = part.iloc[0]
        return folded(part.sort_values("_pos"), (int(first["side"]), first["entry"], int(first["wait"])), rules)

    found = stored(chunks.groupBy("symbol", "_chunk").applyInPandas(maps, "symbol string, _chunk long, found string"), "state-maps")
    starts = found.groupBy("symbol").applyInPandas(compose, "symbol string, _chunk long, side int, entry double, wait int")
    return chunks.join(starts, ["symbol", "_chunk"]).groupBy("symbol", "_chunk").applyInPandas(fold, SCHEMA)


def equity_curves(rows: DataFrame) -> DataFrame:
    """Simulated rows with the growth of holding, and of the strategy before and after fees."""
    kinds = {"buy_hold_equity": "bar_return", "gross_equity": "gross_return", "strategy_equity": "net_return"}
    for name, r in kinds.items():
        rows = equity(rows, r, name=name)
    return rows


def simulation_summary(rows: DataFrame) -> DataFrame:
    """Returns of holding and of the strategy, the greatest loss from a peak of both, and how often each thing happened, for each symbol."""
    counts = ["position_change", "long_entry", "short_entry", "fee_events", "take_profit_exit", "stop_loss_exit", "threshold_exit", "cooldown_blocked"]
    curves = drawdown(drawdown(equity_curves(rows), "buy_hold_equity", name="_held"), "strategy_equity", name="_own")
    total = lambda r, name: (F.product(1 + F.col(r)) - 1).alias(name)
    return curves.groupBy("symbol").agg(
        total("bar_return", "buy_hold_total"), total("gross_return", "gross_total"), total("net_return", "net_total"), F.min("_held").alias("buy_hold_mdd"), F.min("_own").alias("strategy_mdd"), *[F.sum(c).alias(f"n_{c}") for c in counts]
    )
