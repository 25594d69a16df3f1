"""Exact percentiles and ranks of groups of any size.

Values are counted first, so ties and a hot value cost one row per task. The counts
are dealt by range of (group, value) and written; a small table of the rows per
group and range then gives every range its offset, and within a range a window adds
up. No task holds a whole group, and no window is wider than one range (or, for the
offsets, than the number of ranges).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lensframe.session import materialise

_ALL, _PART = "_all", "_part"


def _offsets(dealt: DataFrame, keys: list[str], weight: Column) -> DataFrame:
    """keys, part, _before (rows of the group in earlier ranges), _total."""
    sizes = dealt.groupBy(*keys, _PART).agg(F.sum(weight).alias("_n"))
    w = Window.partitionBy(*keys)
    before = F.sum("_n").over(w.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1))
    return sizes.select(*keys, _PART, F.coalesce(before, F.lit(0)).cast("long").alias("_before"), F.sum("_n").over(w).alias("_total"))


def _dealt(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return materialise(rows.repartitionByRange(*keys, *order).withColumn(_PART, F.spark_partition_id()), "ranks")


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which null keys equal each other."""
    b = b.select(*(F.col(k).alias(f"_b_{k}") for k in keys), *(c for c in b.columns if c not in keys))
    on = [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys]
    return a.join(b, on).drop(*(f"_b_{k}" for k in keys))


def value_counts(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """keys, v, n, below (values of the group before it), total; nulls take no part,
    NaN comes last."""
    c = rows.select(*keys, value.alias("v")).where("v is not null").withColumn(_ALL, F.lit(0))
    by = [_ALL, *keys]
    c = _dealt(c.groupBy(*by, "v").agg(F.count("*").alias("n")), by, ["v"])
    inner = F.sum("n").over(Window.partitionBy(*by, _PART).orderBy("v"))
    r = _same(c.withColumn("_upto", inner), _offsets(c, by, F.col("n")), [*by, _PART])
    return r.select(*keys, "v", "n", (F.col("_before") + F.col("_upto") - F.col("n")).alias("below"), F.col("_total").alias("total"))


def percentiles(rows: DataFrame, keys: list[str], value: Column, wanted: dict[str, float]) -> DataFrame:
    """keys and the wanted percentiles (interpolated between the two nearest values);
    groups without values give no row, but without keys there is always one row."""
    r = value_counts(rows, keys, value)
    holds = lambda at: F.max(F.when((F.col("below") <= at) & (at < F.col("below") + F.col("n")), F.col("v").cast("double")))
    cols = []
    for name, p in wanted.items():
        at = F.lit(float(p)) * (F.col("total") - 1)
        cols += [holds(F.floor(at)).alias(f"_lo_{name}"), holds(F.ceil(at)).alias(f"_hi_{name}"), F.max(at - F.floor(at)).alias(f"_f_{name}")]
    got = r.groupBy(*keys).agg(*cols)
    between = lambda n: F.when(F.col(f"_f_{n}") == 0, F.col(f"_lo_{n}")).otherwise(F.col(f"_lo_{n}") * (1 - F.col(f"_f_{n}")) + F.col(f"_hi_{n}") * F.col(f"_f_{n}"))
    return got.select(*keys, *(between(n).alias(n) for n in wanted))


def numbered(rows: DataFrame, keys: list[str], order: list[str], number: str = "number", total: str | None = None) -> DataFrame:
    """``rows`` with their place in the group's order, from 0 (and the group's size).
    The order ends with what tells rows apart; rows that tie lie in one range."""
    by = [_ALL, *keys]
    d = _dealt(rows.withColumn(_ALL, F.lit(0)), by, order)
    inner = F.row_number().over(Window.partitionBy(*by, _PART).orderBy(*order)) - 1
    r = _same(d.withColumn("_inside", inner), _offsets(d, by, F.lit(1)), [*by, _PART])
    out = r.withColumn(number, F.col("_before") + F.col("_inside"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop(_ALL, _PART, "_inside", "_before", "_total")
