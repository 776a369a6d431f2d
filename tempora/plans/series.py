"""Queries over year series, histories and joins in time and place."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, maths
from ..operators import series, temporal
from .core import nation_series, query, r6, series_sql, t

KNOTS = f"""with {series_sql()}, span as (select n_name, min(year) as a, max(year) as b from series group by 1), grid as (select n_name, unnest(range(a, b + 1))::int as year from span),
k as (select g.n_name, g.year, (select max(year) from series s where s.n_name = g.n_name and s.year <= g.year) as lo, (select min(year) from series s where s.n_name = g.n_name and s.year >= g.year) as hi from grid g)"""


@query("linear_fill", KNOTS + " select k.n_name, k.year, round(l.v + coalesce((h.v - l.v) * (k.year - lo) / nullif(hi - lo, 0), 0), 6) as v from k join series l on l.n_name = k.n_name and l.year = lo join series h on h.n_name = k.n_name and h.year = hi")
def linear_fill(spark, d):
    return series.linear_fill(nation_series(spark, d), "n_name", "year", "v").select("n_name", "year", r6("v").alias("v"))


@query("fill_negatives", "with e as (select user_id, event_id, value - 50 as v from events) select user_id, event_id, round(last_value(case when v >= 0 then v end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row), 6) as v from e")
def fill_negatives(spark, d):
    e = t(spark, d, "events").select("user_id", "event_id", (F.col("value") - 50).alias("v"))
    return series.fill_negatives(e, "user_id", "event_id", "v").select("user_id", "event_id", r6("v").alias("v"))


@query("fit_to_anchors", f"""with {series_sql(False)}, gt as (select n_name, year, v * 2 + 1 as g from series where year % 3 = 0),
j as (select s.n_name, s.year, s.v, gt.g, case when s.v = 0 then case when g = 0 then 0.0 else 1.0 end else g / s.v end as r from series s left join gt using (n_name, year)),
k as (select *, (select max(year) from gt where gt.n_name = j.n_name and gt.year <= j.year) as lo, (select min(year) from gt where gt.n_name = j.n_name and gt.year >= j.year) as hi from j)
select k.n_name, k.year, round(case when k.g is not null then k.g when lo is not null and hi is not null then k.v * (a.r + coalesce((b.r - a.r) * (k.year - lo) / nullif(hi - lo, 0), 0)) else k.v end, 6) as v
from k left join j a on a.n_name = k.n_name and a.year = lo left join j b on b.n_name = k.n_name and b.year = hi""")
def fit_to_anchors(spark, d):
    s = nation_series(spark, d, False)
    gt = s.where("year % 3 = 0").withColumn("v", F.col("v") * 2 + 1)
    return series.fit_to_anchors(s, gt, "n_name", "year", "v").select("n_name", "year", r6("v").alias("v"))


@query("trim_value", f"with {series_sql(False)}, z as (select n_name, year, case when year <= 1993 or year >= 1997 then 0.0 else v end as v from series) select n_name, year, v from z where year between 1994 and 1996")
def trim_value(spark, d):
    z = nation_series(spark, d, False).withColumn("v", F.when((F.col("year") <= 1993) | (F.col("year") >= 1997), 0.0).otherwise(F.col("v")))
    return series.trim(z, "n_name", "year", "v")


@query("expand_value", f"""with {series_sql(False)}, z as (select n_name, year * 10 as year, case when year = 1995 then 0.0 else v end as v from series),
n as (select *, lag(year) over w as p, lead(year) over w as q from z window w as (partition by n_name order by year))
select n_name, year, v from z union all select n_name, y as year, 0.0 as v from (select n_name, unnest([p + 1, q - 1]) as y from n where v = 0) where y is not null""")
def expand_value(spark, d):
    z = nation_series(spark, d, False).select("n_name", (F.col("year") * 10).alias("year"), F.when(F.col("year") == 1995, 0.0).otherwise(F.col("v")).alias("v"))
    return series.expand(z, "n_name", "year", "v")


@query("log_spline_fill")
def log_spline_fill(spark, d):
    return series.spline_fill(nation_series(spark, d), "n_name", "year", "v").withColumn("v", r6("v"))


@query("world_totals", "select year(o_orderdate)::int as year, round(exp(avg(ln(o_totalprice))), 4) as v from orders where o_totalprice > 0 group by 1")
def world_totals(spark, d):
    o = t(spark, d, "orders").where("o_totalprice > 0").select(F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("v"))
    return series.world_totals(o, "year", "v").select("year", r6("v", 4).alias("v"))


@query("weighted_geometric_mean", """select c_mktsegment, round(coalesce(exp(avg(ln(c_acctbal)) filter (c_acctbal > 0)), 0) * (count(*) filter (c_acctbal > 0)) / count(*)
 - coalesce(exp(avg(ln(-c_acctbal)) filter (c_acctbal < 0)), 0) * (count(*) filter (c_acctbal < 0)) / count(*), 4) as v from customer group by 1""")
def weighted_geometric_mean(spark, d):
    return t(spark, d, "customer").groupBy("c_mktsegment").agg(r6(maths.weighted_geometric_mean(F.col("c_acctbal")), 4).alias("v"))


@query("merge_duplicates", "select p_brand, p_size, round(exp(avg(ln(p_retailprice))), 4) as value from part group by 1, 2")
def merge_duplicates(spark, d):
    p = t(spark, d, "part").select("p_brand", "p_size", F.col("p_retailprice").alias("value"))
    return series.merge_duplicates(p, ["p_brand", "p_size"]).select("p_brand", "p_size", r6("value", 4).alias("value"))


@query("melt_years", "with w as (select l_partkey, sum(l_quantity) filter (year(l_shipdate) = 1994) as a, sum(l_quantity) filter (year(l_shipdate) = 1995) as b, sum(l_quantity) filter (year(l_shipdate) = 1996) as c from lineitem group by 1) select l_partkey, 1994 as year, a as value from w where a is not null union all select l_partkey, 1995, b from w where b is not null union all select l_partkey, -1996, c from w where c is not null")
def melt_years(spark, d):
    wide = t(spark, d, "lineitem").select("l_partkey", F.year("l_shipdate").alias("y"), "l_quantity").groupBy("l_partkey").pivot("y", [1994, 1995, 1996]).agg(F.sum("l_quantity")).toDF("l_partkey", "AD_1994", "AD_1995", "BC_1996")
    return series.melt_years(wide, ["l_partkey"])


# Joins over time
EV = "e as (select user_id, event_id, epoch_us(ts) // 1000 as ts, event_type, value from events)"


def events(spark, d):
    return t(spark, d, "events").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), "event_type", "value")


@query("asof_join", f"""with {EV}, p as (select user_id, ts, max(value) as value from e where event_type = 'purchase' group by 1, 2)
select e.user_id, e.event_id, e.ts, p.ts as r_ts, p.value as r_value from (select * from e where event_type = 'view') e asof left join p on e.user_id = p.user_id and e.ts >= p.ts""")
def asof_join(spark, d):
    e = events(spark, d)
    p = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return temporal.asof_join(e.where("event_type = 'view'").select("user_id", "event_id", "ts"), p, ["user_id"], "ts", "ts", ["value"])


NEXT = f"""with {EV}, p as (select user_id, ts, max(value) as value from e where event_type = 'purchase' group by 1, 2), v as (select user_id, event_id, ts from e where event_type = 'view'),
b as (select v.user_id, v.event_id, v.ts, p.ts as before_ts, p.value as before_value from v asof left join p on v.user_id = p.user_id and v.ts >= p.ts),
a as (select v.event_id, p.ts as after_ts, p.value as after_value from v asof left join p on v.user_id = p.user_id and v.ts <= p.ts)"""


@query("bracket_join", NEXT + " select b.*, after_ts, after_value from b join a using (event_id)")
def bracket_join(spark, d):
    e = events(spark, d)
    p = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return temporal.bracket_join(e.where("event_type = 'view'").select("user_id", "event_id", "ts"), p, ["user_id"], "ts", "ts", ["value"])


@query("nearest_join", NEXT + ", j as (select b.*, after_ts, after_value, before_ts is not null and (after_ts is null or ts - before_ts <= after_ts - ts) as early from b join a using (event_id)) select user_id, event_id, ts, case when early then before_ts else after_ts end as near_ts, case when early then before_value else after_value end as near_value from j")
def nearest_join(spark, d):
    e = events(spark, d)
    p = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return temporal.nearest_join(e.where("event_type = 'view'").select("user_id", "event_id", "ts"), p, ["user_id"], "ts", "ts", ["value"])


@query("interval_active", """with s as (select o_orderkey, datediff('day', date '1992-01-01', o_orderdate::date)::int as a, datediff('day', date '1992-01-01', l_shipdate::date)::int as b from orders join lineitem on o_orderkey = l_orderkey), p as (select unnest(range(0, 2400, 30))::int as day)
select day, count(*) as active from p join s on day between a and b group by 1""")
def interval_active(spark, d):
    day = lambda c: F.datediff(F.to_date(c), F.lit("1992-01-01").cast("date"))
    s = t(spark, d, "orders").select("o_orderkey", day("o_orderdate").alias("a")).join(t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), day("l_shipdate").alias("b")), "o_orderkey").where("a <= b")
    points = spark.range(0, 2400, 30).select(F.col("id").cast("int").alias("day"))
    return temporal.interval_join(points, s, "day", "a", "b", 60).groupBy("day").agg(F.count("*").alias("active"))


PLACE = "c as (select c_custkey as id, (c_custkey * 37 % 18000) / 100.0 - 90 as lat, (c_custkey * 91 % 36000) / 100.0 - 180 as lng from customer)"


def places(spark, d):
    c = t(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") * 37 % 18000) / 100.0 - 90).alias("lat"), ((F.col("c_custkey") * 91 % 36000) / 100.0 - 180).alias("lng"))


HAVERSINE = "12742.0 * asin(least(1, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))))"


@query("distance_join", f"with {PLACE} select a.id, b.id as b_id, round({HAVERSINE}, 4) as km from c a join c b on a.id < b.id and abs(a.lat - b.lat) < 3 where {HAVERSINE} < 150")
def distance_join(spark, d):
    p = places(spark, d)
    return temporal.distance_join(p, p, 150.0).where("id < b_id").select("id", "b_id", r6("km", 4).alias("km"))


@query("pixel_coordinates", f"with {PLACE} select id, floor((lng + 180) / 360 * 4320)::int as x, (2160 - floor((lat + 90) / 180 * 2160))::int as y from c")
def pixel_coordinates(spark, d):
    p = places(spark, d)
    px = geo.pixel(F.col("lat"), F.col("lng"))
    return p.select("id", F.get(px, F.lit(0)).alias("x"), F.get(px, F.lit(1)).alias("y"))


# Histories
FRAMES = "k as (select user_id, epoch_us(ts) // 1000 as ts, event_id, case when event_type = 'view' then round(value) end as symbol, case when event_type = 'click' then round(value) end as geometry, case when event_type = 'purchase' then round(value) end as properties from events where event_type in ('view', 'click', 'purchase'))"
FIELDS = ["symbol", "geometry", "properties"]


def frames(spark, d):
    e = events(spark, d).where("event_type in ('view', 'click', 'purchase')")
    pick = lambda kind, name: F.when(F.col("event_type") == kind, F.round("value")).alias(name)
    return e.select("user_id", "ts", "event_id", pick("view", "symbol"), pick("click", "geometry"), pick("purchase", "properties"))


RUN = "rows between unbounded preceding and current row"


@query("history_states", f"with {FRAMES} select user_id, event_id, " + ", ".join(f"last_value({f} ignore nulls) over (partition by user_id order by event_id {RUN}) as {f}" for f in FIELDS) + " from k")
def history_states(spark, d):
    return temporal.states(frames(spark, d), "user_id", "event_id", FIELDS).select("user_id", "event_id", *FIELDS)


@query("state_at", f"with {FRAMES} select user_id, " + ", ".join(f"arg_max({f}, event_id) filter ({f} is not null) as {f}" for f in FIELDS) + " from k where event_id <= 500 group by 1")
def state_at(spark, d):
    return temporal.state_at(frames(spark, d), "user_id", "event_id", FIELDS, F.lit(500))


@query("clean_keyframes", f"with {FRAMES}, p as (select *, " + ", ".join(f"last_value({f} ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as p_{f}" for f in FIELDS) + " from k), c as (select user_id, event_id, " + ", ".join(f"case when {f} is distinct from p_{f} then {f} end as {f}" for f in FIELDS) + " from p) select * from c where " + " or ".join(f"{f} is not null" for f in FIELDS))
def clean_keyframes(spark, d):
    return temporal.clean(frames(spark, d).drop("ts"), "user_id", "event_id", FIELDS)


@query("first_last_with_property", f"with {FRAMES} select user_id, min(event_id) filter (symbol is not null) as first_ts, arg_min(symbol, event_id) filter (symbol is not null) as first_value, max(event_id) filter (symbol is not null) as last_ts, arg_max(symbol, event_id) filter (symbol is not null) as last_value from k group by 1")
def first_last_with_property(spark, d):
    return temporal.first_and_last(frames(spark, d), "user_id", "event_id", "symbol")


@query("upsert_keyframes", f"with {FRAMES}, a as (select user_id, event_id // 10 as slot, max(symbol) as symbol, max(geometry) as geometry from k group by 1, 2), b as (select user_id, event_id // 10 as slot, min(symbol) as symbol, cast(null as double) as geometry from k where event_id % 2 = 0 group by 1, 2) select coalesce(a.user_id, b.user_id) as user_id, coalesce(a.slot, b.slot)::bigint as slot, coalesce(b.symbol, a.symbol) as symbol, coalesce(b.geometry, a.geometry) as geometry from a full join b on a.user_id = b.user_id and a.slot = b.slot")
def upsert_keyframes(spark, d):
    k = frames(spark, d).withColumn("slot", F.floor(F.col("event_id") / 10))
    a = k.groupBy("user_id", "slot").agg(F.max("symbol").alias("symbol"), F.max("geometry").alias("geometry"))
    b = k.where("event_id % 2 = 0").groupBy("user_id", "slot").agg(F.min("symbol").alias("symbol"), F.lit(None).cast("double").alias("geometry"))
    return temporal.upsert(a, b, ["user_id", "slot"], ["symbol", "geometry"])


@query("action_groups", 'with n as (select user_id, event_id, event_type, case when event_type is distinct from lag(event_type) over w or row_number() over w = 1 then 1 else 0 end as new from events window w as (partition by user_id order by event_id)) select user_id, event_id, event_type, sum(new) over (partition by user_id order by event_id)::bigint as "group" from n')
def action_groups(spark, d):
    return temporal.islands(t(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], "event_type")


@query("pivot_variables", "select user_id, max(case when event_type = 'view' then round(value) end) as view, max(case when event_type = 'click' then round(value) end) as click from events group by 1")
def pivot_variables(spark, d):
    m = t(spark, d, "events").groupBy("user_id", "event_type").agg(F.max(F.round("value")).alias("m"))
    return temporal.pivot_variables(m, "user_id", "event_type", "m", ["view", "click"])


@query("display_name", "select c_nationkey, coalesce(arg_max(c_mktsegment, c_custkey) filter (c_custkey <= 100), arg_max(c_mktsegment, c_custkey), 'New polygon') as display_name from customer group by 1")
def display_name(spark, d):
    c = t(spark, d, "customer").select("c_nationkey", "c_custkey", "c_mktsegment", F.lit("polygon").alias("kind"))
    return temporal.display_name(c, "c_nationkey", "c_custkey", "c_mktsegment", "kind", F.lit(100)).select("c_nationkey", "display_name")
