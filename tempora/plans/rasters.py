"""Queries over grids: raking, shares, neighbours, outliers, seeds, overlays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import raster, vector
from ..scratch import written
from .core import GRID, REGION_CELLS, grid_cells, query, r6, region_cells, t

RAKED = f"""with {REGION_CELLS},
z as (select year, region, sum(v) as total from cells group by 1, 2),
raked as (select c.year, c.cell, c.region, ceil(case when z.total <> 0 then v * (1000.0 * (c.region + 1) / z.total) else v end) as v from cells c join z using (year, region))"""


def _targets(cells):
    return cells.select("year", "region").distinct().withColumn("target", 1000.0 * (F.col("region") + 1))


def rake_regional_frame(spark, d):
    cells = region_cells(spark, d)
    return raster.rake(cells, ["year", "region"], _targets(cells))


@query("rake_regional", RAKED + " select year, cell, region, v from raked")
def rake_regional(spark, d):
    return rake_regional_frame(spark, d).select("year", "cell", "region", "v")


@query("rake_global", RAKED + ", w as (select year, sum(v) as total from raked group by 1) select r.year, cell, region, ceil(r.v * (20000.0 / w.total)) as v from raked r join w using (year)")
def rake_global(spark, d):
    cells = written(rake_regional_frame(spark, d))
    targets = cells.select("year").distinct().withColumn("target", F.lit(20000.0))
    return raster.rake(cells, ["year"], targets).select("year", "cell", "region", "v")


@query("rake_missing_zero", f"with {REGION_CELLS}, z as (select year, region, sum(v) as total from cells group by 1, 2) select c.year, cell, c.region, case when c.region < 3 then ceil(v * (500.0 / z.total)) else 0.0 end as v from cells c join z using (year, region)")
def rake_missing_zero(spark, d):
    cells = region_cells(spark, d)
    targets = cells.select("year", "region").distinct().where("region < 3").withColumn("target", F.lit(500.0))
    return raster.rake(cells, ["year", "region"], targets, missing="zero").select("year", "cell", "region", "v")


@query("share_of_total", f"with {REGION_CELLS} select year, cell, region, round(v / sum(v) over (partition by year, region) * 100, 6) as v from cells")
def share_of_total(spark, d):
    return raster.share(region_cells(spark, d), ["year", "region"], of=100.0).select("year", "cell", "region", r6("v").alias("v"))


@query("max_normalise", f"with {REGION_CELLS} select year, cell, region, round(v / max(v) over (partition by year, region), 6) as v from cells")
def max_normalise(spark, d):
    return raster.normalise(region_cells(spark, d), ["year", "region"]).select("year", "cell", "region", r6("v").alias("v"))


@query("grey_levels", f"with {GRID} select year, x, y, least(floor(v / max(v) over (partition by year) * 255 + 0.5), 255)::int as v from grid")
def grey_levels(spark, d):
    return raster.grey_levels(grid_cells(spark, d), ["year"]).select("year", "x", "y", "v")


@query("weight_distribution", f"with {GRID}, g as (select *, floor(v / max(v) over (partition by year) * 255 + 0.5) / 255.0 as w from grid) select year, x, y, ceil(round(w / sum(w) over (partition by year) * 1000000.0, 6)) as v from g")
def weight_distribution(spark, d):
    grey = raster.grey_levels(grid_cells(spark, d), ["year"]).withColumn("v", F.col("v") / 255.0)
    out = raster.share(grey, ["year"], of=1_000_000.0)
    return out.select("year", "x", "y", F.ceil(r6("v")).cast("double").alias("v"))


@query("overlap_mean", f"""with {GRID}, a as (select x, y, sum(v) as v from grid where year <= 1995 group by 1, 2), b as (select x, y, sum(v) as v from grid where year >= 1995 and x % 2 = 0 group by 1, 2)
select coalesce(a.x, b.x) as x, coalesce(a.y, b.y) as y, round(coalesce((a.v + b.v) / 2, a.v, b.v), 6) as v from a full join b on a.x = b.x and a.y = b.y""")
def overlap_mean(spark, d):
    grid = grid_cells(spark, d)
    a, b = (grid.where(w).groupBy("x", "y").agg(F.sum("v").alias("v")) for w in ("year <= 1995", "year >= 1995 and x % 2 = 0"))
    return raster.overlap_mean(a, b, ["x", "y"]).select("x", "y", r6("v").alias("v"))


@query("layer_mean", "select year(l_shipdate)::int as year, l_partkey, round(sum(l_quantity) / 3, 6) as v from lineitem group by 1, 2")
def layer_mean(spark, d):
    cells = t(spark, d, "lineitem").select(F.year("l_shipdate").alias("year"), "l_partkey", F.col("l_quantity").alias("v"))
    return raster.layer_mean(cells, ["year", "l_partkey"], 3).select("year", "l_partkey", r6("v").alias("v"))


NEAR = f"""with {GRID}, n as (
  select a.year, a.x, a.y, any_value(a.v) as v, avg(b.v) as neighbours from grid a
  left join grid b on a.year = b.year and b.x between a.x - 1 and a.x + 1 and b.y between a.y - 1 and a.y + 1 and (a.x <> b.x or a.y <> b.y) group by 1, 2, 3)"""


@query("neighbour_mean", NEAR + " select year, x, y, v, round(neighbours, 6) as neighbours from n")
def neighbour_mean(spark, d):
    return raster.neighbour_mean(grid_cells(spark, d), ["year"]).select("year", "x", "y", "v", r6("neighbours").alias("neighbours"))


@query("outlier_replace", NEAR + " select year, x, y, case when v > neighbours * 2 then round(v / 10, 6) else v end as v from n")
def outlier_replace(spark, d):
    grid = grid_cells(spark, d)
    fallback = grid.withColumn("v", r6(F.col("v") / 10))
    return raster.replace_outliers(grid, fallback, ["year"], 2.0)


@query("nearest_seed", f"""with {GRID}, c as (select distinct x, y from grid), s as (select distinct x, y, x * 100 + y as colour from grid where (x * 7 + y * 3) % 41 = 0),
d as (select c.x, c.y, s.colour, row_number() over (partition by c.x, c.y order by (c.x - s.x) ** 2 + (c.y - s.y) ** 2, s.x, s.y) as n from c join s on (c.x - s.x) ** 2 + (c.y - s.y) ** 2 <= 64)
select c.x, c.y, d.colour from c left join d on c.x = d.x and c.y = d.y and n = 1""")
def nearest_seed(spark, d):
    cells = grid_cells(spark, d).select("x", "y").distinct()
    seeds = cells.where((F.col("x") * 7 + F.col("y") * 3) % 41 == 0).withColumn("colour", F.col("x") * 100 + F.col("y"))
    return raster.nearest_seed(cells, seeds, 8).select("x", "y", "colour")


@query("masked_fill", f"""with {GRID}, g as (select year, y * 64 + x as idx, v from grid), m as (select distinct y * 64 + x as idx, 1993 as s, 1993 + x % 4 as e from grid where x % 5 = 0)
select g.year, g.idx, case when m.idx is not null then 1.0 else v end as v from g left join m on g.idx = m.idx and g.year between s and e""")
def masked_fill(spark, d):
    cells = grid_cells(spark, d).select("year", (F.col("y") * 64 + F.col("x")).alias("idx"), "v", "x")
    masks = cells.where("x % 5 = 0").select("idx", F.lit(1993).alias("start"), (1993 + F.col("x") % 4).alias("end")).distinct()
    return raster.masked_fill(cells.drop("x"), masks, cells.select("year", "idx", F.lit(1.0).alias("v"))).select("year", "idx", "v")


@query("interpolate_years", f"""with {GRID}, g as (select y * 64 + x as idx, year, v from grid where year % 2 = 0), w as (select unnest(range(1992, 1999))::int as year),
i as (select idx, min(year) as a, max(year) as b from g group by 1), c as (select idx, w.year from i join w on w.year between a and b),
k as (select c.idx, c.year, (select max(year) from g where g.idx = c.idx and g.year <= c.year) as lo, (select min(year) from g where g.idx = c.idx and g.year >= c.year) as hi from c)
select k.idx, k.year, greatest(ceil(l.v + coalesce((h.v - l.v) * (k.year - lo) / nullif(hi - lo, 0), 0)), 0)::double as v from k join g l on l.idx = k.idx and l.year = lo join g h on h.idx = k.idx and h.year = hi""")
def interpolate_years(spark, d):
    cells = grid_cells(spark, d).where("year % 2 = 0").select((F.col("y") * 64 + F.col("x")).alias("idx"), "year", "v")
    years = spark.range(1992, 1999).select(F.col("id").cast("int").alias("year"))
    return raster.interpolate_years(cells, years)


BOXES = "boxes as (select p_partkey as shape_id, (p_partkey % 50)::int as x0, ((p_partkey * 7) % 50)::int as y0, p_size % 5 + 1 as w, p_size % 3 + 1 as h, p_retailprice as v from part)"


def boxes(spark, d):
    p = t(spark, d, "part")
    return p.select(F.col("p_partkey").alias("shape_id"), (F.col("p_partkey") % 50).cast("int").alias("x0"), (F.col("p_partkey") * 7 % 50).cast("int").alias("y0"), (F.col("p_size") % 5 + 1).alias("w"), (F.col("p_size") % 3 + 1).alias("h"), F.col("p_retailprice").alias("v"))


BURNT = f"with {BOXES}, a as (select *, unnest(range(x0, x0 + w))::int as x from boxes), b as (select *, unnest(range(y0, y0 + h))::int as y from a)"


@query("rasterise", BURNT + " select x, y, arg_max(v, shape_id) as v, count(*) as layers from b group by 1, 2")
def rasterise(spark, d):
    return raster.rasterise(boxes(spark, d))


@query("rasterise_rings", BURNT + " select x, y, arg_max(v, shape_id) as v from b where x < 64 and y < 64 group by 1, 2")
def rasterise_rings(spark, d):
    from ..functions import geo

    shapes = boxes(spark, d).select("shape_id", "v", geo.rectangle(F.col("x0"), F.col("y0"), F.col("w"), F.col("h")).alias("ring"))
    return vector.rasterise_rings(shapes, 64, 64)


@query("overlay_cells", BURNT + " select x, y, list_sort(list_distinct(list(shape_id % 3))) as pieces from b group by 1, 2")
def overlay_cells(spark, d):
    b = boxes(spark, d).withColumn("x", F.explode(F.expr("sequence(x0, x0 + w - 1)"))).withColumn("y", F.explode(F.expr("sequence(y0, y0 + h - 1)")))
    out = vector.overlay_cells(b.select(F.lit("a").alias("layer"), (F.col("shape_id") % 3).alias("shape_id"), "x", "y"))
    return out.select("x", "y", F.transform("pieces", lambda p: p["shape_id"]).alias("pieces"))


@query("boxes_intersect", f"""with {BOXES} select a.shape_id as a_shape_id, b.shape_id as b_shape_id, ((least(a.x0 + a.w, b.x0 + b.w) - greatest(a.x0, b.x0)) * (least(a.y0 + a.h, b.y0 + b.h) - greatest(a.y0, b.y0)))::int as shared_area
from boxes a join boxes b on a.shape_id < b.shape_id and a.x0 < b.x0 + b.w and b.x0 < a.x0 + a.w and a.y0 < b.y0 + b.h and b.y0 < a.y0 + a.h""")
def boxes_intersect(spark, d):
    b = boxes(spark, d)
    return vector.boxes_intersect(b, b, 8).where("a_shape_id < b_shape_id")


@query("boundary_lengths", f"""with {GRID}, c as (select distinct x, y, (x * 3 + y) % 4 as colour from grid)
select colour, sum(4 - (select count(*) from c n where n.colour = c.colour and abs(n.x - c.x) + abs(n.y - c.y) = 1))::bigint as edges from c group by 1""")
def boundary_lengths(spark, d):
    cells = grid_cells(spark, d).select("x", "y", ((F.col("x") * 3 + F.col("y")) % 4).alias("colour")).distinct()
    return raster.boundary_edges(cells).groupBy("colour").agg(F.count("*").alias("edges"))


@query("polygonise", f"""with {GRID}, c as (select distinct x, y, x // 8 as colour from grid) select colour::int as colour, count(*)::double as area from c group by 1""")
def polygonise(spark, d):
    from ..functions import geo

    cells = grid_cells(spark, d).select("x", "y", F.floor(F.col("x") / 8).cast("int").alias("colour")).distinct()
    return raster.polygonise(cells).groupBy("colour").agg(F.sum(geo.signed_area(F.col("ring"))).alias("area"))


@query("raster_sum", f"with {GRID} select year, sum(v) as total, round(avg(x), 6) as cx, round(avg(y), 6) as cy from grid group by 1")
def raster_sum(spark, d):
    return grid_cells(spark, d).groupBy("year").agg(F.sum("v").alias("total"), r6(F.avg("x")).alias("cx"), r6(F.avg("y")).alias("cy"))
