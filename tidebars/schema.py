"""Schemas of the tables, and checks of columns, nulls, labels and keys that fail early."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_D = T.DoubleType()


def _bars(*extra: str) -> T.StructType:
    fields = [T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampNTZType())]
    return T.StructType(fields + [T.StructField(c, _D) for c in ("open", "high", "low", "close", "volume", *extra)])


#: Bars carry a symbol, so that one table holds many instruments; windows never cross symbols.
BARS, BARS_PLAIN = _bars("turnover"), _bars()


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fail if columns are missing, else project to them in order."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*columns)


def feature_columns(df: DataFrame, excluded: set[str]) -> list[str]:
    """All columns but the excluded ones; a column that begins with target_ among them would leak the future."""
    found = [c for c in df.columns if c not in excluded]
    leaks = [c for c in found if c.startswith("target_")]
    if leaks:
        raise ValueError(f"target columns among the features: {', '.join(leaks)}")
    return found


def resolve_probability(columns: list[str], hints: tuple[str, ...] = ("high", "vol", "1")) -> str:
    """The one column whose lower-case name holds ``proba`` and a hint."""
    found = [c for c in columns if "proba" in c.lower() and any(h in c.lower() for h in hints)]
    if len(found) != 1:
        raise ValueError(f"cannot tell the probability column: {found}")
    return found[0]


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row with the number of nulls in each column."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns or df.columns])


def require_no_nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    counts = {c: n for c, n in null_counts(df, columns).first().asDict().items() if n}
    if counts:
        raise ValueError(f"nulls: {counts}")
    return df


def require_binary(df: DataFrame, label: str) -> DataFrame:
    if not df.where(~F.col(label).isin(0, 1)).isEmpty():
        raise ValueError(f"{label} has values other than 0 and 1")
    return df


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"{', '.join(keys)} are not unique")
    return df
