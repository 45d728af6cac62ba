"""As-of and interval joins, and look-ahead-safe windows (every frame that feeds a model ends before the current row)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotext.operators.known_at import known_at

DAY = 86_400_000_000
#: Tasks over which rows of one span are spread where there is no key.
SALTS = 32


def micros(time: Column) -> Column:
    """Microseconds since 1970 of a date or timestamp, the one time scale of the joins below."""
    return F.unix_micros(time.cast("timestamp"))


def asof(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, payload: Sequence[str],
    direction: str = "backward", tie: Sequence[str] = (), exact: bool = True, skip_null: str | None = None, tolerance_days: float | None = None,
) -> DataFrame:
    """Left rows with the payload of the closest right row before (backward), after (forward) or around (nearest) them.

    Added columns: known_<payload> and known_at (the right time). Rows of equal time: the largest `tie` wins. exact: an
    equal time matches. skip_null: right rows where this column is null never match; otherwise the row matches and its
    null is returned. nearest: of two equally far rows the earlier wins. Beyond tolerance_days nothing matches. Left
    rows without a match keep nulls. `by` may be empty: then all rows are one entity, cut into spans of time only.
    """
    if direction == "nearest":
        back = asof(left, right, by, left_time, right_time, payload, "backward", tie, exact, skip_null, tolerance_days)
        names = [f"known_{c}" for c in payload] + ["known_at"]
        back = back.withColumn("__b", F.struct(*names)).drop(*names)
        both = asof(back, right, by, left_time, right_time, payload, "forward", tie, exact, skip_null, tolerance_days)
        gap = lambda c: F.abs(micros(F.col(c)) - micros(F.col(left_time)))
        earlier = F.col("__b.known_at").isNotNull() & (F.col("known_at").isNull() | (gap("__b.known_at") <= gap("known_at")))
        return both.select(*left.columns, *[F.when(earlier, F.col(f"__b.{n}")).otherwise(F.col(n)).alias(n) for n in names])
    sign = 1 if direction == "backward" else -1
    use = right.filter(F.col(skip_null).isNotNull()) if skip_null else right
    keys = list(by) or ["__all"]
    if not by:
        left, use = left.withColumn("__all", F.lit(1)), use.withColumn("__all", F.lit(1))
    asked = left.withColumn("__lt", micros(F.col(left_time)) * sign)
    given = use.withColumn("__rt", micros(F.col(right_time)) * sign)
    out = known_at(asked, given, keys, "__lt", "__rt", [F.col("__rt"), *[F.col(c) for c in tie]], list(dict.fromkeys([*payload, right_time, "__rt"])), inclusive=exact, salts=1 if by else SALTS)
    far = F.col("__lt") - F.col("known___rt")
    ok = F.lit(True) if tolerance_days is None else far <= int(tolerance_days * DAY)
    named = [F.when(ok, F.col(f"known_{c}")).alias(f"known_{c}") for c in payload]
    kept = [c for c in left.columns if c != "__all"]
    return out.select(*kept, *named, F.when(ok, F.col(f"known_{right_time}")).alias("known_at"))


def bitemporal_asof(events: DataFrame, vintages: DataFrame, by: Sequence[str], day: str, obs: str, vintage: str, value: str) -> DataFrame:
    """The newest observation period on or before `day`, as of the latest non-null vintage published by then."""
    usable = vintages.filter(F.col(value).isNotNull()).withColumn("__avail", F.greatest(obs, vintage))
    return known_at(events, usable, by, day, "__avail", [F.col(obs), F.col(vintage)], [value, obs, vintage])


def assign_window(docs: DataFrame, calendar: DataFrame, day: str, meeting: str) -> DataFrame:
    """docs with the first meeting on or after their day (windows previous < day <= meeting, the first open); null after the last."""
    return asof(docs, calendar, [], day, meeting, [meeting], "forward").drop("known_at").withColumnRenamed(f"known_{meeting}", "window_end")


def lagged_alignment(calendar: DataFrame, order: str, by: Sequence[str] = (), keep_last: bool = True) -> DataFrame:
    """Each calendar row with the next row's date; the last keeps its own, or is dropped."""
    nxt = F.lead(order).over(Window.partitionBy(*by).orderBy(order))
    return calendar.withColumn("aligned", F.coalesce(nxt, F.col(order))) if keep_last else calendar.withColumn("aligned", nxt).filter("aligned is not null")


def nearest_assignment(source: DataFrame, master: DataFrame, source_time: str, master_time: str, value: str, days: float = 5, fill: str | None = None) -> DataFrame:
    """Each source row writes to the closest master row within `days`; the latest source wins. fill: None, 'zero' or 'ffill'."""
    near = asof(source, master, [], source_time, master_time, [master_time], "nearest", tolerance_days=days).filter("known_at is not null")
    wins = near.groupBy(F.col(f"known_{master_time}").alias(master_time)).agg(F.max_by(value, source_time).alias("assigned"))
    out = master.join(wins, master_time, "left")
    if fill == "zero":
        return out.withColumn("assigned", F.coalesce("assigned", F.lit(0)))
    return out.withColumn("assigned", forward_fill("assigned", (), [master_time])) if fill == "ffill" else out


def _w(by: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy(*by).orderBy(*order)


def diff(value: str, by: Sequence[str], order: Sequence[str], rows: int = 1) -> Column:
    return F.col(value) - F.lag(value, rows).over(_w(by, order))


def lag_by_span(df: DataFrame, by: Sequence[str], order: str, span: Column, value: str, out: str) -> DataFrame:
    """df with the value of the row before in its group, by an order column that is unique in it.

    span: an expression that never falls as the order rises (a prefix, a day). A group is cut into its spans, so that a hot
    one is many tasks; only the last row of each span travels to the beginning of the next. Null groups are groups.
    """
    cut = df.withColumn("__span", span)
    inner = Window.partitionBy(*by, "__span").orderBy(order)
    lasts = cut.groupBy(*by, "__span").agg(F.max_by(F.struct(value), order).alias("__last"))
    lasts = lasts.withColumn("__carried", F.lag("__last").over(Window.partitionBy(*by).orderBy("__span"))).drop("__last")
    names = {c: f"__{i}_k" for i, c in enumerate([*by, "__span"])}
    same = F.lit(True)
    for c, n in names.items():
        same = same & F.col(c).eqNullSafe(F.col(n))
    both = cut.withColumns({"__n": F.row_number().over(inner), "__before": F.lag(value).over(inner)}).join(lasts.withColumnsRenamed(names), same, "left")
    return both.select(*df.columns, F.when(F.col("__n") > 1, F.col("__before")).otherwise(F.col(f"__carried.{value}")).alias(out))


def lead_target(value: str, by: Sequence[str], order: Sequence[str], rows: int = 1) -> Column:
    return F.lead(value, rows).over(_w(by, order))


def next_date(day: str, by: Sequence[str], order: Sequence[str], placeholder_days: int = 45) -> Column:
    """The next row's date; after the last, a placeholder."""
    return F.coalesce(F.lead(day).over(_w(by, order)), F.date_add(day, placeholder_days))


def forward_fill(value: str, by: Sequence[str], order: Sequence[str]) -> Column:
    return F.last(value, ignorenulls=True).over(_w(by, order).rowsBetween(Window.unboundedPreceding, 0))


def percent_change(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str], rows: int = 12, pad: bool = True, out: str = "change") -> DataFrame:
    """value / value `rows` rows ago - 1; pad fills gaps forward first."""
    base = df.withColumn("__v", forward_fill(value, by, order) if pad else F.col(value))
    return base.withColumn(out, F.try_divide("__v", F.nullif(F.lag("__v", rows).over(_w(by, order)), F.lit(0))) - 1).drop("__v")


def expanding_z(value: str, by: Sequence[str], order: Sequence[str], least: int = 3) -> Column:
    """(x - mean) / sample deviation of the rows before; null with fewer than `least` of them or no spread."""
    past = _w(by, order).rowsBetween(Window.unboundedPreceding, -1)
    sd = F.stddev_samp(value).over(past)
    return F.when((F.count(value).over(past) >= least) & (sd > 0), (F.col(value) - F.avg(value).over(past)) / sd)


def expanding_centered(value: str, by: Sequence[str], order: Sequence[str], least: int = 10) -> Column:
    past = _w(by, order).rowsBetween(Window.unboundedPreceding, -1)
    return F.when(F.count(value).over(past) >= least, F.col(value) - F.avg(value).over(past))


def rolling_variance(value: str, by: Sequence[str], order: Sequence[str], rows: int = 10, least: int = 3, scale: float = 1.0) -> Column:
    w = _w(by, order).rowsBetween(1 - rows, 0)
    return F.when(F.count(value).over(w) >= least, F.var_samp(value).over(w) / scale)


def running_sum(value: str, by: Sequence[str], order: Sequence[str]) -> Column:
    return F.sum(value).over(_w(by, order).rowsBetween(Window.unboundedPreceding, 0))


def position_share(by: Sequence[str], order: Sequence[str]) -> Column:
    """i / max(n - 1, 1), from 0."""
    return (F.row_number().over(_w(by, order)) - 1) / F.greatest(F.count("*").over(Window.partitionBy(*by)) - 1, F.lit(1))


def keep_one(df: DataFrame, by: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row for each key, the first in the order (a map-side combined minimum is not possible for whole rows of any type)."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("__n = 1").drop("__n")


def resample(df: DataFrame, time: str, value: str, unit: str = "quarter", by: Sequence[str] = (), tie: Sequence[str] = ()) -> DataFrame:
    """Mean, first and last value of each calendar bucket, with its first and last day."""
    bucket = F.date_trunc(unit, F.col(time).cast("timestamp")).cast("date")
    months = {"month": 1, "quarter": 3, "year": 12}[unit]
    at = F.struct(time, *tie)
    return df.groupBy(*by, bucket.alias("bucket_start")).agg(F.avg(value).alias("mean"), F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last")).withColumn("bucket_end", F.date_sub(F.add_months("bucket_start", months), 1))


def daily_grid(df: DataFrame, day: str, by: Sequence[str] = ()) -> DataFrame:
    """Every day from the first to the last of each group; a join source for reindexing."""
    return df.groupBy(*by).agg(F.min(day).alias("a"), F.max(day).alias("b")).select(*by, F.explode(F.sequence("a", "b")).alias(day))


def interpolate_monthly(df: DataFrame, day: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Straight lines between consecutive points, at the first of each month from the first point to the last."""
    w = _w(by, [day])
    spans = df.withColumn("__d2", F.lead(day).over(w)).withColumn("__v2", F.lead(value).over(w))
    months = F.explode(F.when(F.col("__d2").isNull(), F.array(day)).otherwise(F.sequence(day, F.date_sub("__d2", 1), F.expr("interval 1 month"))))
    part = F.datediff("month_start", day) / F.datediff("__d2", day)
    return spans.select(*by, day, value, "__d2", "__v2", months.alias("month_start")).select(*by, "month_start", F.when(F.col("__d2").isNull(), F.col(value)).otherwise(F.col(value) + (F.col("__v2") - F.col(value)) * part).alias("interpolated"))
