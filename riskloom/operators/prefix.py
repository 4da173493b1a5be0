"""Ordered prefix aggregates that stay balanced when one key is hot.

"How many earlier rows share my key, what do they sum to, when was the last
one" is a window from the start of the key up to the row before. A plain window
sends a whole key to one task. Here the rows of a hot key are cut into slices of
consecutive rows first:

1. a small sample gives split points of the order and a table of the hot keys;
2. rows of hot keys get the number of their slice, all others slice -1;
3. the window runs inside (key, slice);
4. one partly pre-aggregated row per (hot key, slice) gives the running total of
   the slices before, which is added to step 3. That join uses the columns the
   window is already partitioned and sorted by, so the rows do not move again.

The sample only decides where slices are cut. Whatever it says, the result is
exact, because the cut points are fixed literals before step 2 starts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLICE = "__slice"
_KEY = ["__key", "__key_null"]

# A task should sort no more rows of one key than this, nor more than one in
# LEAST_SLICES of the table. Slices, hot keys and sample grow with the counted rows.
ROWS_PER_SLICE = 2_000_000
LEAST_SLICES = 64
SAMPLED_PER_SLICE = 1_000


@dataclass(frozen=True)
class OrderProfile:
    """Split points of an order, and the hot values of some key columns."""

    splits: tuple[float, ...] = ()
    tie_low: float = 0.0
    tie_high: float = 0.0
    hot: dict[str, tuple] = field(default_factory=dict)


def _position(time: str, tie: str | None, low: float, high: float) -> Column:
    """One double that never falls as (time, tie) rises.

    The tie-breaker becomes a fraction below one, so rows that share one time
    value can still be cut apart.
    """
    # A NULL comes first, as it does in the window's order.
    at = F.coalesce(F.col(time).cast("double"), F.lit(float("-inf")))
    if tie is None:
        return at
    fraction = (F.col(tie).cast("double") - F.lit(low)) / F.lit(high - low + 1.0)
    return at + F.greatest(F.lit(0.0), F.least(fraction, F.lit(0.999999)))


def slice_count(rows: int) -> int:
    return max(LEAST_SLICES, -(-rows // ROWS_PER_SLICE))


def draw_sample(df: DataFrame, rows: int) -> DataFrame:
    """About SAMPLED_PER_SLICE rows for each slice, in a few partitions.

    Sketches of the sample are then merged from a few tasks, not from as many
    as the table has splits.
    """
    fraction = min(1.0, SAMPLED_PER_SLICE * slice_count(rows) / max(rows, 1))
    sample = df if fraction == 1.0 else df.sample(fraction, seed=11)
    return sample.repartition(min(32, df.sparkSession.sparkContext.defaultParallelism))


def _quantiles(column: Column, slices: int) -> Column:
    return F.percentile_approx(column, F.lit(np.arange(1, slices) / slices), 10 * slices)


def _rising(quantiles: list | None) -> tuple[float, ...]:
    return tuple(sorted({float(q) for q in quantiles or []} - {float("-inf")}))


def quantile_splits(df: DataFrame, columns: list[str], rows: int) -> list[tuple]:
    """Inner split points of each column from a sample, strictly rising."""
    slices = slice_count(rows)
    sample = draw_sample(df.select(*columns), rows)
    found = sample.agg(*[_quantiles(F.col(c), slices).alias(c) for c in columns]).first()
    return [_rising(q) for q in found]


def profile_order(
    df: DataFrame,
    time: str,
    tie: str | None = None,
    keys: tuple[str, ...] = (),
) -> OrderProfile:
    """Look at a sample of ``df``: where to cut its order, which keys are hot.

    A key is hot when it holds more rows than a slice should. There are fewer such keys
    than slices, so what comes to the driver is one number and one value
    per ROWS_PER_SLICE rows. Estimates are good enough: they move cut points, not results.
    """
    wanted = [time] + ([tie] if tie else []) + list(keys)
    narrow = df.select(*dict.fromkeys(wanted))
    number = F.col(tie).cast("double") if tie else F.lit(0.0)
    rows, low, high = narrow.agg(F.count(F.lit(1)), F.min(number), F.max(number)).first()
    if not rows:
        return OrderProfile()
    slices = slice_count(rows)
    sample = draw_sample(narrow, rows)
    at = _position(time, tie, low or 0.0, high or 0.0)
    splits = _rising(sample.agg(_quantiles(at, slices)).first()[0])
    return OrderProfile(splits, low or 0.0, high or 0.0, hot_values(sample, keys, min(rows, SAMPLED_PER_SLICE * slices) / slices))


def hot_values(sample: DataFrame, keys: tuple[str, ...], enough: float) -> dict[str, tuple]:
    """The values of each key column, as text, with more than ``enough`` rows of the sample: counted, not sketched.

    There are fewer of them than slices, however many values the sample has.
    """
    if not keys:
        return {}
    named = [F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys]
    counts = sample.select(F.explode(F.array(*named)).alias("v")).groupBy("v.key", "v.value").agg(F.count(F.lit(1)).alias("n"))
    found = counts.filter(F.col("n") > enough).select("key", "value").collect()
    return {k: tuple(sorted((r.value for r in found if r.key == k), key=lambda v: (v is not None, v or ""))) for k in keys}


def bucketize(df: DataFrame, source: str, splits: tuple, target: str) -> DataFrame:
    """Number of split points at or below ``source``, as int; NULL stays apart."""
    if not splits:
        return df.withColumn(target, F.lit(0))
    cut = Bucketizer(
        inputCol=source,
        outputCol=target,
        splits=[float("-inf"), *splits, float("inf")],
        handleInvalid="keep",
    )
    return cut.transform(df).withColumn(target, F.col(target).cast("int"))


def assign_slices(
    df: DataFrame, profile: OrderProfile, time: str, tie: str | None = None, key: str | None = None
) -> DataFrame:
    """Add the slice number: -1 for keys that stay whole."""
    if not profile.splits or key is not None and not profile.hot.get(key):
        return df.withColumn(SLICE, F.lit(-1))
    at = _position(time, tie, profile.tie_low, profile.tie_high)
    out = bucketize(df.withColumn("__at", at), "__at", profile.splits, SLICE).drop("__at")
    if key is None:
        return out
    hot = hot_table(df.sparkSession, profile.hot[key])
    out = out.join(F.broadcast(hot), F.col(key).cast("string").eqNullSafe(F.col("__hot_value")), "left")
    return out.withColumn(SLICE, F.when(F.col("__is_hot"), F.col(SLICE)).otherwise(-1)).drop("__hot_value", "__is_hot")


def hot_table(spark: SparkSession, values: tuple) -> DataFrame:
    """Hot values as a table: one row per ROWS_PER_SLICE rows of the data at most, so it may be sent to all tasks."""
    rows = pa.table({"__hot_value": pa.array(values, pa.string()), "__is_hot": pa.array([True] * len(values), pa.bool_())})
    return spark.createDataFrame(rows)


def with_key(df: DataFrame, key: str) -> DataFrame:
    """Replace the key by two never-NULL columns, so that NULL is a key too."""
    kind = df.schema[key].dataType
    stand_in = F.lit("") if kind.typeName() == "string" else F.lit(0).cast(kind)
    return df.withColumns(
        {_KEY[0]: F.coalesce(F.col(key), stand_in), _KEY[1]: F.col(key).isNull()}
    ).drop(key)


def prefix_aggregate(
    df: DataFrame,
    order: list[str],
    profile: OrderProfile | None = None,
    key: str | None = None,
    count: str | None = None,
    sums: dict[str, str] | None = None,
    previous: str | None = None,
    carry: DataFrame | None = None,
    carry_extra: tuple[str, ...] = (),
    only: DataFrame | None = None,
    totals_from: DataFrame | None = None,
) -> DataFrame:
    """Aggregate, for each row, the rows before it in ``order`` within ``key``.

    Slices come from ``profile``, or ``df`` already has a slice column whose
    numbers rise with ``order``. ``count`` names the number of earlier rows,
    ``sums`` maps output name to summed column (NULL when no earlier row),
    ``previous`` names the first order column of the row just before. ``carry``
    holds one row per key with the same output columns, for rows handled before
    those of ``df`` (the latest time of both counts as previous); its columns ``carry_extra`` are copied to each row of
    the key. ``only`` (rows with the columns of ``df``) limits the
    output to the slices those rows are in; earlier slices then enter as totals
    and are not sorted. ``totals_from`` may name a cheaper source of the same
    rows for the totals.
    """
    sums = sums or {}
    keys = _KEY if key is not None else []
    groups = keys + [SLICE]
    time = order[0]
    whole = profile is not None and (not profile.splits or key is not None and not profile.hot.get(key))
    cut = carry is not None or not whole

    def prepare(frame: DataFrame) -> DataFrame:
        if profile is not None:
            frame = assign_slices(frame, profile, *order, key=key)
        return with_key(frame, key) if key is not None else frame

    names = df.columns
    df = prepare(df)
    only = prepare(only) if only is not None else None
    rows = df
    if only is not None:
        rows = rows.join(only.select(*groups).distinct(), groups, "left_semi")

    in_order = Window.partitionBy(*groups).orderBy(*order)
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    local = {}
    if count:
        local["__n"] = F.count(F.lit(1)).over(before)
    for name, column in sums.items():
        local[f"__s_{name}"] = F.sum(column).over(before)
    if previous:
        local["__p"] = F.lag(time).over(in_order)
    rows = rows.withColumns(local)

    base = None
    if cut:
        totals = df if totals_from is None else prepare(totals_from)
        base = _slice_offsets(totals, keys, time, count, sums, previous, carry, carry_extra, key)
    if base is not None:
        rows = rows.join(base, groups, "left")

    def plus(here: str, earlier: str) -> Column:
        if base is None:
            return F.col(here)
        return F.when(F.col(earlier).isNull(), F.col(here)).otherwise(
            F.coalesce(F.col(here), F.lit(0)) + F.col(earlier)
        )

    result = []
    if count:
        result.append(plus("__n", "__b_n").alias(count))
    for name in sums:
        result.append(plus(f"__s_{name}", f"__b_s_{name}").alias(name))
    if previous:
        last = F.col("__p") if base is None else F.greatest(F.col("__p"), F.col("__b_p"))
        result.append(last.alias(previous))
    if key is not None:
        result.append(F.when(~F.col(_KEY[1]), F.col(_KEY[0])).alias(key))
    kept = [c for c in names if c not in (SLICE, key)]
    return rows.select(*kept, *result, *carry_extra)


def _slice_offsets(df, keys, time, count, sums, previous, carry, carry_extra, key):
    """Totals of everything before each slice.

    At most one row per (hot key, slice) leaves the pre-aggregation, so the
    window over slices sees at most one row per slice of any key.
    """
    cut = df if carry is not None else df.filter(F.col(SLICE) >= 0)
    measures = []
    if count:
        measures.append(F.count(F.lit(1)).alias("__t_n"))
    measures += [F.sum(c).alias(f"__t_s_{n}") for n, c in sums.items()]
    if previous:
        measures.append(F.max(time).alias("__t_p"))
    totals = cut.groupBy(*keys, SLICE).agg(*measures)

    earlier = (
        Window.partitionBy(*(keys or [F.lit(0)]))
        .orderBy(SLICE)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    running = {}
    if count:
        running["__b_n"] = F.sum("__t_n").over(earlier)
    for name in sums:
        running[f"__b_s_{name}"] = F.sum(f"__t_s_{name}").over(earlier)
    if previous:
        running["__b_p"] = F.max("__t_p").over(earlier)
    offsets = totals.select(*keys, SLICE, *[v.alias(k) for k, v in running.items()])
    if carry is None:
        return offsets

    past = with_key(carry, key)
    past = past.select(
        *keys,
        *([F.col(count).alias("__c_n")] if count else []),
        *[F.col(n).alias(f"__c_s_{n}") for n in sums],
        *([F.col(previous).alias("__c_p")] if previous else []),
        *carry_extra,
    )
    joined = offsets.join(past, keys, "left")

    def add(a: str, b: str) -> Column:
        both = F.coalesce(F.col(a), F.lit(0)) + F.coalesce(F.col(b), F.lit(0))
        return F.when(F.col(a).isNotNull() | F.col(b).isNotNull(), both)

    merged = {}
    if count:
        merged["__b_n"] = add("__b_n", "__c_n")
    for name in sums:
        merged[f"__b_s_{name}"] = add(f"__b_s_{name}", f"__c_s_{name}")
    if previous:
        merged["__b_p"] = F.greatest(F.col("__b_p"), F.col("__c_p"))
    return joined.select(*keys, SLICE, *[v.alias(k) for k, v in merged.items()], *carry_extra)


def time_rank(df: DataFrame, time: str, tie: str, name: str):
    """Zero-based position of each row in (time, tie) order, without one big sort."""
    profile = profile_order(df, time, tie)
    return prefix_aggregate(df, [time, tie], profile, count=name)
