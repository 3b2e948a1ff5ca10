"""As-of and checked joins of series."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import require_unique


def asof_join(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("symbol",), time: str = "ts") -> DataFrame:
    """Each left row with the last right row of its key whose time is not later; null where there is none.

    Both sides are put into one series, right rows ahead of left ones of equal time, and the last right row is
    carried forward: one shuffle and one sort, no join of ranges. Of right rows of one time the greatest wins.
    """
    values = [c for c in right.columns if c not in (*keys, time)]
    own = [c for c in left.columns if c not in (*keys, time)]
    a = left.select(*keys, time, F.lit(1).alias("_side"), F.struct(*own).alias("_own"), F.lit(None).cast(right.select(F.struct(*values).alias("v")).schema["v"].dataType).alias("_seen"))
    b = right.select(*keys, time, F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*own).alias("v")).schema["v"].dataType).alias("_own"), F.struct(*values).alias("_seen"))
    w = Window.partitionBy(*keys).orderBy(time, "_side", "_seen").rowsBetween(Window.unboundedPreceding, 0)
    seen = a.unionByName(b).withColumn("_seen", F.last("_seen", ignorenulls=True).over(w)).where("_side = 1")
    return seen.select(*keys, time, "_own.*", "_seen.*")


def null_safe_join(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same names, of which null equals null."""
    other = right.select(*[F.col(c).alias(f"_r_{c}") if c in names else F.col(c) for c in right.columns])
    return left.join(other, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in names]), how).drop(*[f"_r_{c}" for c in names])


def left_join_checked(left: DataFrame, right: DataFrame, keys: list[str], must_match: bool = True) -> DataFrame:
    """Left join on keys unique on both sides; with ``must_match`` a left row without a partner is an error."""
    require_unique(left, keys)
    marked = require_unique(right, keys).withColumn("_found", F.lit(True))
    out = left.join(marked, keys, "left")
    if must_match and not out.where("_found IS NULL").isEmpty():
        raise ValueError("rows without a partner")
    return out.drop("_found")


def unmatched_count(left: DataFrame, right: DataFrame, keys: list[str]) -> int:
    return left.join(right, keys, "left_anti").count()


def inner_join_one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return require_unique(left, keys).join(require_unique(right, keys), keys)


def with_close(predictions: DataFrame, bars: DataFrame, keys: list[str]) -> DataFrame:
    """Attach close (and the next return) only if the predictions lack it."""
    out = predictions if "close" in predictions.columns else left_join_checked(predictions, bars.select(*keys, "close"), keys, must_match=False)
    if "target_return_next" not in out.columns:
        w = Window.partitionBy(*[k for k in keys if k != "ts"]).orderBy("ts")
        out = out.withColumn("target_return_next", F.try_divide(F.lead("close").over(w), F.col("close")) - 1)
    return out
