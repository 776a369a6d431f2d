"""Grids as rows (layer, year, idx, v) or (…, x, y, v): sums by zone, raking, neighbours, outliers, rings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import WIDTH


def zonal_sum(cells: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    return cells.groupBy(*keys).agg(F.sum(v).alias("total"))


def rake(cells: DataFrame, keys: list[str], targets: DataFrame, target: str = "target", v: str = "v", ceil: bool = True, missing: str = "keep") -> DataFrame:
    """Cells scaled so that each zone's sum meets its target; factor 1 where the zone sums to 0 or has no target.

    The sums are a partial aggregate that shrinks to one row a zone before the
    shuffle; the scale factors, not the cells, are what is joined. With
    `missing="zero"` cells without a target become 0. `ceil` stores whole numbers.
    """
    known = F.col(target).isNotNull()
    factor = F.when(known & (F.col("total") != 0), F.col(target) / F.col("total")).otherwise(F.lit(1.0))
    if missing == "zero":
        factor = F.when(known, factor).otherwise(F.lit(0.0))
    scale = zonal_sum(cells, keys, v).join(targets, keys, "left").select(*keys, factor.alias("_f"))
    value = F.coalesce(F.col(v) * F.col("_f"), F.col(v) if missing == "keep" else F.lit(0.0))
    return cells.join(scale, keys, "left").withColumn(v, F.ceil(value).cast("double") if ceil else value).drop("_f")


def share(cells: DataFrame, keys: list[str], v: str = "v", of: Column | float = 1.0) -> DataFrame:
    """v / zone sum * of."""
    totals = zonal_sum(cells, keys, v)
    return cells.join(totals, keys).withColumn(v, F.coalesce(F.try_divide(F.col(v), F.col("total")), F.lit(0.0)) * of).drop("total")


def normalise(cells: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    """v / zone maximum; 0 where that is 0."""
    top = cells.groupBy(*keys).agg(F.max(v).alias("_m"))
    return cells.join(top, keys).withColumn(v, F.coalesce(F.try_divide(F.col(v), F.col("_m")), F.lit(0.0))).drop("_m")


def grey_levels(cells: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    """0 … 255 by the zone's maximum."""
    return normalise(cells, keys, v).withColumn(v, F.least(F.floor(F.col(v) * 255 + 0.5), F.lit(255)).cast("int"))


def layer_mean(cells: DataFrame, keys: list[str], layers: int, v: str = "v") -> DataFrame:
    """Mean over `layers` layers; one that lacks a cell counts 0."""
    return cells.groupBy(*keys).agg((F.sum(v) / layers).alias(v))


def overlap_mean(a: DataFrame, b: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    """Mean where both have a cell, else the one that has it."""
    l, r = a.select(*keys, F.col(v).alias("_a")), b.select(*keys, F.col(v).alias("_b"))
    return l.join(r, keys, "full").select(*keys, F.coalesce((F.col("_a") + F.col("_b")) / 2, "_a", "_b").alias(v))


def neighbour_mean(cells: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    """`neighbours`: the mean of the up to 8 cells around each; null without any.

    Each cell sends its value to its neighbours and the sums combine before the
    shuffle, so no pairs of cells are joined.
    """
    steps = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    sent = cells.select(*keys, "x", "y", v, F.explode(steps).alias("d"))
    own = (F.col("d.dx") == 0) & (F.col("d.dy") == 0)
    target = sent.select(*keys, (F.col("x") + F.col("d.dx")).alias("x"), (F.col("y") + F.col("d.dy")).alias("y"), F.when(own, F.col(v)).alias("_own"), own.alias("_is"), F.when(~own, F.col(v)).alias("_near"))
    return target.groupBy(*keys, "x", "y").agg(F.max("_own").alias(v), F.avg("_near").alias("neighbours"), F.max("_is").alias("_is")).where("_is").drop("_is")


def replace_outliers(cells: DataFrame, fallback: DataFrame, keys: list[str], factor: float = 8.0, v: str = "v") -> DataFrame:
    """Cells over `factor` times their neighbours' mean take the fallback's value."""
    f = fallback.select(*keys, "x", "y", F.col(v).alias("_f"))
    out = neighbour_mean(cells, keys, v).join(f, [*keys, "x", "y"], "left")
    return out.withColumn(v, F.when(F.col(v) > F.col("neighbours") * factor, F.coalesce("_f", F.lit(0.0))).otherwise(F.col(v))).select(*keys, "x", "y", v)


def nearest_seed(cells: DataFrame, seeds: DataFrame, reach: int, colour: str = "colour") -> DataFrame:
    """Each cell with the colour of its nearest seed within `reach` (squared distance, then least x, y); null beyond.

    Seeds are sent to square bins of `reach` around them, so the join is by bin.
    """
    div = lambda c: F.floor(F.col(c) / reach).cast("bigint")
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    s = seeds.select(F.col("x").alias("_sx"), F.col("y").alias("_sy"), colour, F.explode(around).alias("d"), div("x").alias("_bx"), div("y").alias("_by"))
    s = s.select("_sx", "_sy", colour, (F.col("_bx") + F.col("d.i")).alias("_bx"), (F.col("_by") + F.col("d.j")).alias("_by"))
    near = cells.withColumns({"_bx": div("x"), "_by": div("y")}).join(s, ["_bx", "_by"])
    d2 = F.pow(F.col("x") - F.col("_sx"), F.lit(2)) + F.pow(F.col("y") - F.col("_sy"), F.lit(2))
    best = near.withColumn("_d", d2).where(F.col("_d") <= reach * reach).groupBy("x", "y").agg(F.min_by(colour, F.struct("_d", "_sx", "_sy")).alias(colour))
    return cells.join(best, ["x", "y"], "left")


def masked_fill(cells: DataFrame, masks: DataFrame, fallback: DataFrame, v: str = "v") -> DataFrame:
    """Cells (year, idx) under a mask (idx, start, end) that is active in their year take the fallback's value."""
    hit = cells.join(masks, "idx").where(F.col("year").between(F.col("start"), F.col("end"))).select("year", "idx").distinct().withColumn("_hit", F.lit(True))
    f = fallback.select("year", "idx", F.col(v).alias("_f"))
    return cells.join(hit, ["year", "idx"], "left").join(f, ["year", "idx"], "left").withColumn(v, F.when(F.col("_hit"), F.coalesce("_f", F.lit(0.0))).otherwise(F.col(v))).drop("_hit", "_f")


def interpolate_years(cells: DataFrame, years: DataFrame, v: str = "v") -> DataFrame:
    """Cells (idx, year, v) also at the given years, linear between the years around, whole numbers of at least 0.

    The years are few and the cells many: each cell's knots are gathered once
    (bounded by the number of layers) and every wanted year is read off them.
    """
    knots = cells.groupBy("idx").agg(F.sort_array(F.collect_list(F.struct("year", F.col(v).cast("double").alias("v")))).alias("k"))
    wanted = years.agg(F.sort_array(F.collect_set("year")).alias("w"))
    out = knots.crossJoin(F.broadcast(wanted)).select("idx", "k", F.explode("w").alias("year"))
    low = F.expr("get(filter(k, e -> e.year <= year), size(filter(k, e -> e.year <= year)) - 1)")
    high = F.expr("get(filter(k, e -> e.year >= year), 0)")
    both = out.select("idx", "year", low.alias("a"), high.alias("b")).where("a is not null and b is not null")
    at = F.col("a.v") + F.coalesce(F.try_divide((F.col("b.v") - F.col("a.v")) * (F.col("year") - F.col("a.year")), F.col("b.year") - F.col("a.year")), F.lit(0.0))
    return both.select("idx", "year", F.greatest(F.ceil(at), F.lit(0)).cast("double").alias(v))


def rasterise(shapes: DataFrame, width: int = WIDTH) -> DataFrame:
    """Axis-aligned shapes (shape_id, x0, y0, w, h, v) burnt into cells; the last shape wins."""
    xs, ys = F.sequence(F.col("x0"), F.col("x0") + F.col("w") - 1), F.sequence(F.col("y0"), F.col("y0") + F.col("h") - 1)
    cells = shapes.select("shape_id", "v", F.explode(xs).alias("x"), "y0", "h").select("shape_id", "v", "x", F.explode(F.sequence(F.col("y0"), F.col("y0") + F.col("h") - 1)).alias("y"))
    return cells.groupBy("x", "y").agg(F.max_by("v", "shape_id").alias("v"), F.count("*").alias("layers"))


def boundary_edges(cells: DataFrame, colour: str = "colour") -> DataFrame:
    """Directed unit edges around each colour's region, the region on the left: an edge whose reverse exists lies inside and cancels."""
    e = lambda *p: F.struct(*[(F.col(a) + d).alias(n) for n, a, d in zip(("x0", "y0", "x1", "y1"), ("x", "y", "x", "y"), p, strict=True)])
    edges = cells.select(colour, F.explode(F.array(e(0, 0, 1, 0), e(1, 0, 1, 1), e(1, 1, 0, 1), e(0, 1, 0, 0))).alias("e")).select(colour, "e.*")
    way = F.when((F.col("x0") < F.col("x1")) | (F.col("y0") < F.col("y1")), 1).otherwise(-1)
    low, high = F.least(F.struct("x0", "y0"), F.struct(F.col("x1").alias("x0"), F.col("y1").alias("y0"))), F.greatest(F.struct("x0", "y0"), F.struct(F.col("x1").alias("x0"), F.col("y1").alias("y0")))
    net = edges.select(colour, low.alias("a"), high.alias("b"), way.alias("w")).groupBy(colour, "a", "b").agg(F.sum("w").alias("w")).where("w <> 0")
    first, last = F.when(F.col("w") > 0, F.col("a")).otherwise(F.col("b")), F.when(F.col("w") > 0, F.col("b")).otherwise(F.col("a"))
    return net.select(colour, first["x0"].alias("x0"), first["y0"].alias("y0"), last["x0"].alias("x1"), last["y0"].alias("y1"))


def polygonise(cells: DataFrame, colour: str = "colour") -> DataFrame:
    """(colour, ring): closed rings around equal colours, from the boundary edges of each colour."""
    import pandas as pd

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        ahead: dict[tuple, list[tuple]] = {}
        for r in pdf.sort_values(["x0", "y0", "x1", "y1"]).itertuples():
            ahead.setdefault((r.x0, r.y0), []).append((r.x1, r.y1))
        rings = []
        for start in sorted(ahead):
            while ahead[start]:
                ring, at, came = [], start, None
                while True:
                    ring.append([float(at[0]), float(at[1])])
                    exits = ahead[at]
                    # where two corners touch, keep to the own region: turn left first
                    exits.sort(key=lambda p, at=at, came=came: 0 if came is None else -((at[0] - came[0]) * (p[1] - at[1]) - (at[1] - came[1]) * (p[0] - at[0])))
                    came, at = at, exits.pop(0)
                    if at == start:
                        break
                rings.append(ring)
        return pd.DataFrame({colour: [pdf[colour].iloc[0]] * len(rings), "ring": rings})

    kind = cells.schema[colour].dataType.simpleString()
    return boundary_edges(cells, colour).groupBy(colour).applyInPandas(trace, f"{colour} {kind}, ring array<array<double>>")


def running_rank(df: DataFrame, by: str, *order: Column) -> DataFrame:
    return df.withColumn("z", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
