"""Composed batch pipelines: ordered stages over grids and city series."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import nodes
from ..operators import raster, series, temporal
from .core import GRID, grid_cells, query, r6, t
from .series import EV, events, places


def staged(df: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], exclude: tuple[str, ...] = ()) -> DataFrame:
    """Stages one after the other, those named in `exclude` left out."""
    for name, stage in stages:
        if name not in exclude:
            df = df.transform(stage)
    return df


def land_use(cells: DataFrame, years: DataFrame, zones: DataFrame, regional: DataFrame, world: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(idx, year, v): missing years interpolated, then raked to regional and to world totals, whole numbers after each stage."""
    return staged(
        cells,
        [
            ("interpolate", lambda df: raster.interpolate_years(df, years)),
            ("regional", lambda df: raster.rake(df.join(zones, "idx"), ["year", "region"], regional).select("idx", "year", "v")),
            ("world", lambda df: raster.rake(df, ["year"], world)),
        ],
        exclude,
    )


def blended_weights(a: DataFrame, b: DataFrame, world: DataFrame, layers: int) -> DataFrame:
    """(idx, year, v): two sources averaged where they overlap, and the world's total distributed by weight."""
    mean = raster.layer_mean(a, ["year", "idx"], layers)
    both = raster.overlap_mean(mean, b, ["year", "idx"])
    spread = raster.share(both, ["year"]).join(world, "year")
    return spread.select("idx", "year", F.ceil(r6(F.col("v") * F.col("target"))).cast("double").alias("v"))


#: Rows that are folded at a time, and most cells (cities times years) of a table of theirs.
FOLD_ROWS, FOLD_CELLS = 1 << 18, 1 << 22


def _fold(pdf: pd.DataFrame) -> pd.DataFrame:
    """One city's rows, whatever their years; `_fold_many` does the same for many cities."""
    mine = pdf[pdf["match"].isna()].set_index("year")["v"].astype(float).sort_index()
    for _, rows in pdf[pdf["match"].notna()].sort_values("match").groupby("match"):
        theirs = rows.set_index("year")["v"].astype(float).sort_index()
        shared = mine.index.intersection(theirs.index)
        higher = shared[theirs[shared].to_numpy() > mine[shared].to_numpy()]
        mine[higher] = (mine[higher] + theirs[higher]) / 2
        if len(shared) > 1:
            ratio = np.where(mine[shared] == 0, np.where(theirs[shared] == 0, 0.0, 1.0), theirs[shared] / mine[shared].replace(0, 1.0))
            inside = mine.index[(mine.index >= shared[0]) & (mine.index <= shared[-1])]
            mine[inside] = mine[inside].to_numpy() * np.interp(inside.to_numpy(float), shared.to_numpy(float), ratio)
    return pd.DataFrame({"id": int(pdf["id"].iloc[0]), "year": mine.index.astype("int32"), "v": np.round(mine.to_numpy())})


def _fold_many(city: np.ndarray, nth: np.ndarray, at: np.ndarray, v: np.ndarray, years: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(city, at, v) of folded series: the n-th matches of all cities at once. Rows are sorted by city and nth (0: the city's own); `at` is the place in `years`."""
    n, k, column = int(city[-1]) + 1, len(years), np.arange(len(years))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, city, nth)
    order = np.argsort(-most, kind="stable")  # those with an n-th match come first
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    by = np.argsort(nth, kind="stable")
    cuts = np.searchsorted(nth[by], np.arange(int(nth.max()) + 2))
    mine, has = np.zeros((n, k)), np.zeros((n, k), bool)
    for j, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        rows = by[a:b]
        if not j:
            mine[place[city[rows]], at[rows]], has[place[city[rows]], at[rows]] = v[rows], True
            continue
        size = int((most >= j).sum())
        m, own, theirs, shared = mine[:size], has[:size], np.zeros((size, k)), np.zeros((size, k), bool)
        theirs[place[city[rows]], at[rows]], shared[place[city[rows]], at[rows]] = v[rows], True
        shared &= own
        m[:] = np.where(shared & (theirs > m), (m + theirs) / 2, m)
        ratio = np.where(m == 0, np.where(theirs == 0, 0.0, 1.0), theirs / np.where(m == 0, 1.0, m))
        lo = np.maximum.accumulate(np.where(shared, column, -1), axis=1)
        hi = np.minimum.accumulate(np.where(shared, column, k)[:, ::-1], axis=1)[:, ::-1]
        inside = own & (lo >= 0) & (hi < k) & (shared.sum(axis=1) > 1)[:, None]
        r, c = np.nonzero(inside)
        p, q = lo[r, c], hi[r, c]
        low, high, step = ratio[r, p], ratio[r, q], (years[q] - years[p]).astype(float)
        m[r, c] *= np.where(p == q, low, (high - low) / np.where(p == q, 1.0, step) * (years[c] - years[p]) + low)
    mine, has = mine[place], has[place]
    r, c = np.nonzero(has)
    return r, c, np.round(mine[r, c])


def _fold_table(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Folds whole cities, sorted by id, match (own rows first) and year. Cities with repeated years or without some value go one by one."""
    ids, year = rows["id"].to_numpy(), rows["year"].fill_null(0).to_numpy()
    own, match, v = rows["match"].is_null().to_numpy(), rows["match"].fill_null(0).to_numpy(), rows["v"].fill_null(np.nan).to_numpy()
    new_city = np.concatenate([[True], ids[1:] != ids[:-1]])
    new_series = new_city | np.concatenate([[True], (match[1:] != match[:-1]) | (own[1:] != own[:-1])])
    city, firsts = np.cumsum(new_city) - 1, np.flatnonzero(new_city)
    bad = ~np.isfinite(v) | rows["year"].is_null().to_numpy() | np.concatenate([[False], (year[1:] == year[:-1]) & ~new_series[1:]]) | (new_city & ~own)
    odd = np.zeros(len(firsts), bool)
    odd[city[bad]] = True
    for i in np.flatnonzero(odd):
        end = firsts[i + 1] if i + 1 < len(firsts) else len(ids)
        yield pa.RecordBatch.from_pandas(_fold(rows.slice(firsts[i], end - firsts[i]).to_pandas()).astype({"id": "int64", "year": "int32", "v": "float64"}), preserve_index=False)
    nth = np.cumsum(new_series) - 1
    nth -= nth[firsts][city]
    fine = np.flatnonzero(~odd[city])
    if not len(fine):
        return
    years, at = np.unique(year[fine], return_inverse=True)
    group = max(1, FOLD_CELLS // len(years))
    cuts = np.searchsorted(city[fine], np.arange(0, city[-1] + 1 + group, group))
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            part = fine[a:b]
            names, of = np.unique(city[part], return_inverse=True)
            r, c, out = _fold_many(of, nth[part], at[a:b], v[part], years)
            yield pa.RecordBatch.from_arrays([pa.array(ids[firsts[names]][r], pa.int64()), pa.array(years[c], pa.int32()), pa.array(out, pa.float64())], names=["id", "year", "v"])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= FOLD_ROWS:
            rows = pa.Table.from_batches(held)
            ids = rows["id"].to_numpy()
            whole = int(np.searchsorted(ids, ids[-1]))  # the last city may go on
            if whole:
                yield from _fold_table(rows.slice(0, whole))
                held = rows.slice(whole).to_batches()
            size = len(ids) - whole if whole else 0
    if held and sum(b.num_rows for b in held):
        yield from _fold_table(pa.Table.from_batches(held))


def union_cities(main: DataFrame, other: DataFrame, km: float = 5.0) -> DataFrame:
    """(id, year, v): each city's series folded with those of the other source's cities within `km`, in order of id.

    A match first averages the years in which it is larger, then bends the
    series to it by ratio between its years; the result is rounded. One city
    and its matches are one group.
    """
    near = temporal.distance_join(main.select("id", "lat", "lng").distinct(), other.select("id", "lat", "lng").distinct(), km).select("id", F.col("b_id").alias("match"))
    own = main.select("id", F.lit(None).cast("bigint").alias("match"), "year", "v")
    matched = near.join(other.select(F.col("id").alias("match"), "year", "v"), "match").select("id", "match", "year", "v")

    rows = own.unionByName(matched).select("id", "match", F.col("year").cast("int"), F.col("v").cast("double"))
    return rows.repartition("id").sortWithinPartitions("id", "match", "year").mapInArrow(_folded, "id long, year int, v double")


def sample_colours(polities: DataFrame, grids: DataFrame, colours: DataFrame) -> DataFrame:
    """(id, year, colour): polities (id, from, to, x, y) with the colour at their place in the layer nearest to their middle year."""
    middle = F.floor((F.col("from") + F.col("to")) / 2).cast("int")
    years = grids.agg(F.collect_set("year").alias("_years"))  # one row; a layer is a whole raster, so its years are few
    nearest = F.array_min(F.transform("_years", lambda y: F.struct(F.abs(y - middle).alias("d"), y.alias("year"))))["year"]
    near = polities.crossJoin(F.broadcast(years)).withColumn("year", nearest)
    return near.join(colours, ["year", "x", "y"], "left").select("id", "year", "colour")


@query("land_use_pipeline", f"""with {GRID}, g as (select y * 64 + x as idx, year, v from grid where year % 2 = 0), w as (select unnest(range(1992, 1999))::int as year),
i as (select idx, min(year) as a, max(year) as b from g group by 1), c as (select idx, w.year from i join w on w.year between a and b),
k as (select c.idx, c.year, (select max(year) from g where g.idx = c.idx and g.year <= c.year) as lo, (select min(year) from g where g.idx = c.idx and g.year >= c.year) as hi from c),
f as (select k.idx, k.year, greatest(ceil(l.v + coalesce((h.v - l.v) * (k.year - lo) / nullif(hi - lo, 0), 0)), 0)::double as v from k join g l on l.idx = k.idx and l.year = lo join g h on h.idx = k.idx and h.year = hi),
z as (select year, idx % 4 as region, sum(v) as total from f group by 1, 2), r as (select f.idx, f.year, ceil(f.v * (5000.0 * (idx % 4 + 1) / z.total)) as v from f join z on z.year = f.year and z.region = f.idx % 4),
y as (select year, sum(v) as total from r group by 1) select r.idx, r.year, ceil(r.v * (100000.0 / y.total)) as v from r join y using (year)""")
def land_use_pipeline(spark, d):
    cells = grid_cells(spark, d).where("year % 2 = 0").select((F.col("y") * 64 + F.col("x")).alias("idx"), "year", "v")
    years = spark.range(1992, 1999).select(F.col("id").cast("int").alias("year"))
    zones = cells.select("idx").distinct().withColumn("region", F.col("idx") % 4)
    regional = years.crossJoin(spark.range(4).select(F.col("id").cast("int").alias("region"))).withColumn("target", 5000.0 * (F.col("region") + 1))
    return land_use(cells, years, zones, regional, years.withColumn("target", F.lit(100000.0)))


@query("blended_weights", f"""with {GRID}, a as (select year, y * 64 + x as idx, sum(v) / 2 as v from grid where year <= 1996 group by 1, 2), b as (select year, y * 64 + x as idx, v from grid where year >= 1996),
m as (select coalesce(a.year, b.year) as year, coalesce(a.idx, b.idx) as idx, coalesce((a.v + b.v) / 2, a.v, b.v) as v from a full join b on a.year = b.year and a.idx = b.idx)
select idx, year, ceil(round(v / sum(v) over (partition by year) * (1000000.0 + year), 6)) as v from m""")
def blended_weights_query(spark, d):
    cells = grid_cells(spark, d).select("year", (F.col("y") * 64 + F.col("x")).alias("idx"), "v")
    world = cells.select("year").distinct().withColumn("target", 1_000_000.0 + F.col("year"))
    return blended_weights(cells.where("year <= 1996"), cells.where("year >= 1996"), world, 2)


@query("union_cities")
def union_cities_query(spark, d):
    p = places(spark, d)
    year = spark.range(1800, 1830, 10).select(F.col("id").cast("int").alias("year"))
    main = p.crossJoin(F.broadcast(year)).withColumn("v", (F.col("id") % 97 + F.col("year") % 13).cast("double"))
    other = p.select("id", (F.col("lat") + 0.01).alias("lat"), "lng").crossJoin(F.broadcast(year)).withColumn("v", (F.col("id") % 89 + 20).cast("double"))
    return union_cities(main.where("lat < 89"), other.where("lat < 89"))


@query("sample_colours", f"""with {GRID}, c as (select year, x, y, (x + y + year)::int as colour from grid), p as (select p_partkey as id, 1990 + (p_partkey % 12)::int as "from", 1990 + (p_partkey % 12)::int + p_size % 9 as "to", (p_partkey % 64)::int as x, (p_partkey % 32)::int as y from part),
m as (select *, floor(("from" + "to") / 2.0)::int as mid from p), n as (select id, arg_min(g.year, {{'d': abs(g.year - mid), 'y': g.year}}) as year from m, (select distinct year from grid) g group by 1)
select m.id, n.year, c.colour from m join n using (id) left join c on c.year = n.year and c.x = m.x and c.y = m.y""")
def sample_colours_query(spark, d):
    grid = grid_cells(spark, d)
    k = F.col("p_partkey")
    start = (1990 + k % 12).cast("int")
    polities = t(spark, d, "part").select(k.alias("id"), start.alias("from"), (start + F.col("p_size") % 9).alias("to"), (k % 64).cast("int").alias("x"), (k % 32).cast("int").alias("y"))
    return sample_colours(polities, grid, grid.select("year", "x", "y", (F.col("x") + F.col("y") + F.col("year")).alias("colour")))


@query("node_program", "select p_partkey as id, i::int as turn, (p_size * 2.0 + i) as total, upper('n') || '-' || p_partkey as label from part, range(0, 3) as t(i) where p_size > 20")
def node_program(spark, d):
    nodes.custom("twice", [("d", "multiply_numbers", ["$x", 2.0])], ["x"], "d")
    program = [
        ("total", "add_numbers", ["@doubled", "@turn"]),
        ("big", "greater_than", ["$size", 20]),
        ("gate", "if_then", ["@big"]),
        ("doubled", "twice", ["$size"]),
        ("turn", "for_loop", [3]),
        ("label", "add_strings", ["N-", "$id"]),
    ]
    p = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("size"))
    return nodes.run(p, program, ["turn", "total", "label"]).drop("size")


@query("node_values", "select p_partkey as id, p_size = 5 as same, (p_size > 5) <> (p_size > 9) as either, case when p_size = 0 then 0 else p_size % 4 end::double as rest, replace(p_type, 'E', 'e') as text, regexp_replace(p_type, 'E', 'e') as first, len(string_split(p_type, ' '))::int as words, 'a,b' as joined, 1::bigint as at from part")
def node_values(spark, d):
    n = nodes.NODES
    s, kind = F.col("p_size").cast("double"), F.col("p_type")
    ab = F.array(F.lit("a"), F.lit("b"))
    return t(spark, d, "part").select(
        F.col("p_partkey").alias("id"), n["is_strictly_equal"](s, F.lit(5.0)).alias("same"), n["xor"](s > 5, s > 9).alias("either"), n["modulo_numbers"](s, F.lit(4.0)).alias("rest"), n["string_replace_all"](kind, F.lit("E"), F.lit("e")).alias("text"),
        n["string_replace"](kind, F.lit("E"), F.lit("e")).alias("first"), n["array_length"](n["split_string"](kind, F.lit(" "))).alias("words"), n["join_array"](ab, F.lit(",")).alias("joined"), n["array_indexof"](ab, F.lit("b")).alias("at"),
    )


@query("log_drained", f"with {EV} select user_id, count(*) as n, max(ts) as last_ts from e group by 1")
def log_drained(spark, d):
    """The same fold that the streaming form runs in batches."""
    return events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))


@query("spline_totals")
def spline_totals(spark, d):
    totals = series.world_totals(t(spark, d, "orders").where("o_totalprice > 0").select(F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("v")), "year", "v")
    return series.spline_fill(totals.where("year % 2 = 0").withColumn("all", F.lit("world")), "all", "year", "v").withColumn("v", r6("v", 4))
