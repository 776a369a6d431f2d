"""Joins over time and place, and keyframe histories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo


def _both(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, carry: list[str]) -> DataFrame:
    """Both sides in one frame (`_side` 0 right, 1 left), the right side's columns in the struct `_r`: one shuffle by key serves the join."""
    r = right.select(*by, F.col(right_ts).alias("_ts"), F.struct(F.col(right_ts).alias("ts"), *carry).alias("_r"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_l"))
    l_ = left.select(*by, F.col(left_ts).alias("_ts"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"))
    return r.unionByName(l_)


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, carry: list[str], prefix: str = "r_") -> DataFrame:
    """Each left row with the right row of its key that is the latest at or before it; nulls where there is none.

    Union and a running last value: one shuffle and one sort, no row pairs.
    """
    w = Window.partitionBy(*by).orderBy("_ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = _both(left, right, by, left_ts, right_ts, carry).withColumn("_hit", F.last("_r", True).over(w)).where("_side = 1")
    return out.select("_l.*", F.col("_hit.ts").alias(f"{prefix}ts"), *[F.col(f"_hit.{c}").alias(prefix + c) for c in carry])


def bracket_join(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, carry: list[str]) -> DataFrame:
    """Each left row with the right rows around it: before_* (at or before) and after_* (at or after)."""
    back = Window.partitionBy(*by).orderBy("_ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy(F.desc("_ts"), "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = _both(left, right, by, left_ts, right_ts, carry).withColumns({"_b": F.last("_r", True).over(back), "_a": F.last("_r", True).over(ahead)}).where("_side = 1")
    return out.select("_l.*", *[F.col(f"{s}.{c}").alias(f"{p}_{c}") for s, p in (("_b", "before"), ("_a", "after")) for c in ("ts", *carry)])


def nearest_join(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, carry: list[str]) -> DataFrame:
    """Each left row with the right row at the least distance in time, the earlier of equals; numeric times."""
    both = bracket_join(left, right, by, left_ts, right_ts, carry)
    back, ahead = F.col(left_ts) - F.col("before_ts"), F.col("after_ts") - F.col(left_ts)
    earlier = F.col("before_ts").isNotNull() & (F.col("after_ts").isNull() | (back <= ahead))
    return both.select(*left.columns, *[F.when(earlier, F.col(f"before_{c}")).otherwise(F.col(f"after_{c}")).alias(f"near_{c}") for c in ("ts", *carry)])


def interval_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: int) -> DataFrame:
    """Points within [start, end] of spans, whole numbers: both sides are dealt to bins of `width`, so the join is an equi-join and short spans meet few points."""
    div = lambda c: F.floor(F.col(c) / width).cast("bigint")
    p = points.withColumn("_bin", div(at))
    s = spans.withColumn("_bin", F.explode(F.sequence(div(start), div(end))))
    return p.join(s, "_bin").where(F.col(at).between(F.col(start), F.col(end))).drop("_bin")


def distance_join(a: DataFrame, b: DataFrame, km: float, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Pairs within `km`; the columns of b get b_. Both sides are dealt to latitude bands and longitude cells as wide as the limit at their band.

    The right side is sent to its neighbour cells, so each pair meets once.
    """
    step = km / 111.19  # degrees of latitude
    band = lambda c: F.floor((c + 90) / step).cast("bigint")

    def cells(n: Column) -> Column:  # cells around a band's circle, all at least `km` wide at its outer edge
        edge = F.least(F.greatest(F.abs(n * step - 90), F.abs((n + 1) * step - 90)) + step, F.lit(89.999))
        return F.greatest(F.floor(F.cos(F.radians(edge)) * 360 / step).cast("bigint"), F.lit(1))

    left = a.withColumn("_band", band(F.col(lat))).withColumn("_cell", F.floor((F.col(lng) + 180) / 360 * cells(F.col("_band"))).cast("bigint"))
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
    right = right.withColumn("_band", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: band(F.col(f"b_{lat}")) + d)))
    n = cells(F.col("_band"))
    own = F.floor((F.col(f"b_{lng}") + 180) / 360 * n).cast("bigint")
    near = F.array_distinct(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: F.pmod(own + d, n)))
    right = right.withColumn("_cell", F.explode(near))
    d = geo.haversine(F.col(lat), F.col(lng), F.col(f"b_{lat}"), F.col(f"b_{lng}"))
    joined = left.withColumn("_cell", F.pmod("_cell", cells(F.col("_band")))).join(right, ["_band", "_cell"])
    return joined.withColumn("km", d).where(F.col("km") < km).drop("_band", "_cell")


# Histories: (entity, ts, slot columns); null in a slot means "as before"
def upsert(history: DataFrame, new: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """New keyframes laid over those of equal key, field by field."""
    both = history.select(*key, *fields, F.lit(0).alias("_n")).unionByName(new.select(*key, *fields, F.lit(1).alias("_n")))
    return both.groupBy(*key).agg(*[F.max_by(F.struct(f), F.when(F.col(f).isNotNull(), F.col("_n")))[f].alias(f) for f in fields])


def states(history: DataFrame, entity: str, ts: str, fields: list[str]) -> DataFrame:
    """Each keyframe with the whole state that holds from it on."""
    w = Window.partitionBy(entity).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    return history.withColumns({f: F.last(f, True).over(w) for f in fields})


def state_at(history: DataFrame, entity: str, ts: str, fields: list[str], when: Column) -> DataFrame:
    """The state of each entity at a time: per field the last value at or before it, by a partial aggregate."""
    return history.where(F.col(ts) <= when).groupBy(entity).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(ts))).alias(f) for f in fields])


def clean(history: DataFrame, entity: str, ts: str, fields: list[str]) -> DataFrame:
    """Fields equal to the running state become null, and keyframes without fields go."""
    w = Window.partitionBy(entity).orderBy(ts).rowsBetween(Window.unboundedPreceding, -1)
    out = history.withColumns({f"_{f}": F.last(f, True).over(w) for f in fields})
    out = out.withColumns({f: F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), F.col(f)) for f in fields}).drop(*[f"_{f}" for f in fields])
    return out.where(reduce(Column.__or__, [F.col(f).isNotNull() for f in fields]))


def remove(history: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return history.join(gone.select(*key), key, "left_anti")


def move(history: DataFrame, entity: str, ts: str, moves: DataFrame) -> DataFrame:
    """Keyframes re-dated by (entity, from, to)."""
    m = moves.select(F.col("entity").alias(entity), F.col("from").alias(ts), F.col("to").alias("_to"))
    return history.join(m, [entity, ts], "left").withColumn(ts, F.coalesce("_to", ts)).drop("_to")


def first_and_last(history: DataFrame, entity: str, ts: str, field: str) -> DataFrame:
    """First and last keyframe of each entity that holds a field."""
    has = F.when(F.col(field).isNotNull(), F.col(ts))
    return history.groupBy(entity).agg(F.min(has).alias("first_ts"), F.min_by(field, has).alias("first_value"), F.max(has).alias("last_ts"), F.max_by(field, has).alias("last_value"))


def islands(df: DataFrame, by: list[str], order: list[str], key: str) -> DataFrame:
    """`group` numbers the runs of equal `key` in order, from 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    change = F.when(~F.col(key).eqNullSafe(F.lag(key).over(w)) | (F.row_number().over(w) == 1), 1).otherwise(0)
    return df.withColumn("_new", change).withColumn("group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def pivot_variables(history: DataFrame, ts: str, name: str, value: str, names: list[str]) -> DataFrame:
    return history.groupBy(ts).pivot(name, names).agg(F.first(value, True))


def display_name(history: DataFrame, entity: str, ts: str, name: str, kind: str, when: Column) -> DataFrame:
    """The name as of a time, else the last name at all, else "New " and the kind."""
    has = F.when(F.col(name).isNotNull(), F.col(ts))
    asof = F.max_by(name, F.when(F.col(ts) <= when, has))
    return history.groupBy(entity, kind).agg(F.coalesce(asof, F.max_by(name, has), F.concat(F.lit("New "), F.first(kind))).alias("display_name"))
