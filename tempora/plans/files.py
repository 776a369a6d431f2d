"""Queries over sources and sinks: a table written in a format, read back by its reader, must give the table's rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import entities
from ..scratch import place
from ..sources import files, rasters
from ..streaming import ontology
from .core import GRID, grid_cells, query, t


def text_file(df, column: str, name: str) -> str:
    """One file of the column's lines in their present order."""
    path = place(df.sparkSession, name)
    df.select(column).coalesce(1).write.text(path)
    return path


@query("csv_roundtrip", "select p_partkey as id, p_name || ', \"' || p_type || '\"' as label, p_retailprice as price from part")
def csv_roundtrip(spark, d):
    path = place(spark, "csv")
    rows = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(', "'), "p_type", F.lit('"')).alias("label"), F.col("p_retailprice").alias("price"))
    rows.write.csv(path, header=True, quote='"', escape='"')
    return files.csv(spark, path).select(F.col("id").cast("bigint").alias("id"), "label", F.col("price").cast("double").alias("price"))


@query("csv_vertical", "select n_regionkey::varchar as region, list(n_name order by n_nationkey) as nation from nation group by 1")
def csv_vertical(spark, d):
    path = place(spark, "csv")
    t(spark, d, "nation").orderBy("n_nationkey").select(F.col("n_regionkey").alias("region"), F.col("n_name").alias("nation")).coalesce(1).write.csv(path, header=True)
    return files.csv_vertical(spark, path)


@query("csv_horizontal", "select 'r_regionkey' as col, list(r_regionkey::varchar order by r_regionkey) as values from region union all select 'r_name', list(r_name order by r_regionkey) from region")
def csv_horizontal(spark, d):
    path = place(spark, "csv")
    t(spark, d, "region").orderBy("r_regionkey").select("r_regionkey", "r_name").coalesce(1).write.csv(path, header=True)
    return files.csv_horizontal(spark, path)


@query("file_listing", "select n_nationkey % 3 as part, sum(strlen(n_name) + 1)::bigint as length, true as fresh from nation group by 1")
def file_listing(spark, d):
    path = place(spark, "list")
    t(spark, d, "nation").select((F.col("n_nationkey") % 3).alias("part"), "n_name").repartition(1).write.partitionBy("part").text(path)
    found = files.listing(spark, path, "*.txt")
    return found.select(F.regexp_extract("path", r"part=(\d+)", 1).cast("bigint").alias("part"), "length", F.col("age_seconds").between(-60, 3600).alias("fresh"))


@query("base64_files", "select unnest(list(n_name order by n_nationkey)) as line from nation")
def base64_files(spark, d):
    path = text_file(t(spark, d, "nation").orderBy("n_nationkey"), "n_name", "b64")
    whole = files.base64_files(spark, f"{path}/*.txt").select(F.unbase64("base64").cast("string").alias("text"))
    return whole.select(F.explode(F.split(F.rtrim("text"), "\n")).alias("line")).where("line <> ''")


@query("lines_backwards", "select (row_number() over (order by c_custkey) - 1)::int as line_no, c_name as line from customer")
def lines_backwards(spark, d):
    return files.lines_backwards(spark, text_file(t(spark, d, "customer").orderBy("c_custkey"), "c_name", "lines"))


@query("loose_json", "select n_nationkey as id, n_name as name from nation")
def loose_json(spark, d):
    n = t(spark, d, "nation")
    path = text_file(n.agg(F.array_join(F.collect_list(F.concat(F.lit("{id: "), "n_nationkey", F.lit(", 'name': '"), "n_name", F.lit("' /* a comment */}"))), ",\n").alias("body")).select(F.concat(F.lit("["), "body", F.lit("]")).alias("text")), "text", "json")
    return files.loose_json(spark, path, "id bigint, name string")


@query("geojson_features", "select (row_number() over (order by n_nationkey) - 1)::int as feature_id, n_name as name, case when n_nationkey % 2 = 0 then 'Polygon' else 'MultiPolygon' end as kind, n_nationkey::double as corner, 1 as parts from nation")
def geojson_features(spark, d):
    k = F.col("n_nationkey").cast("string")
    ring = F.concat(F.lit("[[["), k, F.lit(",0],["), k, F.lit(",1],[5,5],["), k, F.lit(",0]]]"))
    even = F.col("n_nationkey") % 2 == 0
    shape = F.concat(F.lit('{"type":"'), F.when(even, "Polygon").otherwise("MultiPolygon"), F.lit('","coordinates":'), F.when(even, ring).otherwise(F.concat(F.lit("["), ring, F.lit("]"))), F.lit("}"))
    feature = F.concat(F.lit('{"type":"Feature","properties":{"name":"'), "n_name", F.lit('"},"geometry":'), shape, F.lit("}"))
    all_of = t(spark, d, "nation").agg(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", feature.alias("f")))), lambda s: s["f"]).alias("a"))
    path = text_file(all_of.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join("a", ","), F.lit("]}")).alias("text")), "text", "geojson")
    p = F.col("polygons")
    return files.geojson(spark, path).select("feature_id", F.col("properties")["name"].alias("name"), "kind", p[0][0][0][0].alias("corner"), F.size("polygons").alias("parts"))


@query("project_roundtrip", "select 'customer_' || o_custkey as id, 'Polygon' as class_name, 'geometry' as type, o_orderkey as ts, [o_orderstatus, case when o_orderkey % 3 <> 0 then o_orderpriority end] as value from orders")
def project_roundtrip(spark, d):
    path = place(spark, "project")
    o = t(spark, d, "orders")
    value = F.array(F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")))
    files.write_project(o.select(F.concat(F.lit("customer_"), "o_custkey").alias("id"), F.lit("Polygon").alias("class_name"), F.lit("geometry").alias("type"), F.col("o_orderkey").alias("ts"), value.alias("value")), path)
    return files.project_lines(spark, path)


@query("html_tables", "select n_nationkey as id, unnest([0, 0, 1, 1])::int as row, unnest([0, 1, 0, 1])::int as col, unnest(['key', 'name', n_nationkey::varchar, n_name]) as text, unnest([false, false, false, true]) as linked from nation")
def html_tables(spark, d):
    html = F.concat(F.lit("<p>x</p><table><tr><th>key</th><th>name</th></tr><tr><td> "), F.col("n_nationkey").cast("string"), F.lit('</td><td><a href="/x">'), "n_name", F.lit("</a></td></tr></table>"))
    pages = t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), html.alias("html"))
    return files.html_tables(pages, "id", "html").drop("table")


@query("texts_by_tag", "select n_nationkey as id, n_name || chr(10) || 'b ' || n_regionkey as text from nation")
def texts_by_tag(spark, d):
    html = F.concat(F.lit('<h1 class="a top">'), "n_name", F.lit('</h1><p>no<br>thing</p><div id="k"><b>b</b> '), F.col("n_regionkey").cast("string"), F.lit("</div>"))
    return files.texts_by_tag(t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), html.alias("html")), "id", "html", ["h1.top", "#k", "em"])


@query("crawl", "select 'http://a.b/' || p_partkey as url, (p_partkey - 1)::int as depth from part where p_partkey between 1 and 4")
def crawl(spark, d):
    p = t(spark, d, "part")
    link = F.concat(F.lit('<a href="/'), (F.col("p_partkey") + 1).cast("string"), F.lit('">next</a>'))
    return files.crawl(p.select(F.concat(F.lit("http://a.b/"), "p_partkey").alias("url"), link.alias("html")), ["http://a.b/1"], 3)


@query("find_in_files", "select (row_number() over (order by p_partkey) - 1)::int as line_no, p_type as line, replace(p_type, 'SMALL', 'small') as replaced from part qualify regexp_matches(p_type, '\\bSMALL\\b')")
def find_in_files(spark, d):
    path = text_file(t(spark, d, "part").orderBy("p_partkey"), "p_type", "find")
    return files.replace_in_lines(files.find_in_files(spark, path, "small", case=False, whole_word=True), "SMALL", "small").drop("file")


def year_grid(spark, d):
    return grid_cells(spark, d).select("year", F.col("y").alias("row"), F.col("x").alias("col"), "v")


def read_years(cells):
    """Cells of files named by their year."""
    return cells.where("v is not null").select(F.col("file").cast("int").alias("year"), "row", "col", "v")


@query("asc_roundtrip", f"with {GRID} select year, y as row, x as col, v from grid")
def asc_roundtrip(spark, d):
    return read_years(rasters.read_asc(spark, rasters.grids_as_files(year_grid(spark, d), 64, 32, lambda g: rasters.asc_text(g).encode())))


@query("png_roundtrip", f"with {GRID} select year, y as row, x as col, ceil(v / 2)::double as v from grid")
def png_roundtrip(spark, d):
    cells = year_grid(spark, d).withColumn("v", F.col("v") / 2)
    return read_years(rasters.read_png(spark, rasters.grids_as_files(cells, 64, 32, lambda g: rasters.png_bytes(rasters.encode_numbers(g))))).where("v > 0")


@query("netcdf_roundtrip", f"with {GRID} select year, y as row, x as col, v from grid")
def netcdf_roundtrip(spark, d):
    stored = rasters.grids_as_files(year_grid(spark, d), 64, 32, lambda g: rasters.netcdf_bytes("pop", np.stack([g * 0, g])))
    return read_years(rasters.read_netcdf(spark, stored, "pop").where("layer = 1"))


@query("netcdf_variables", f"with {GRID} select distinct year, 'pop' as variable, ['time', 'lat', 'lon'] as dims, [1, 32, 64] as shape from grid")
def netcdf_variables(spark, d):
    stored = rasters.grids_as_files(year_grid(spark, d), 64, 32, lambda g: rasters.netcdf_bytes("pop", g[None]))
    return rasters.netcdf_variables(spark, stored).select(F.col("file").cast("int").alias("year"), "variable", "dims", "shape")


@query("tiff_bands", f"with {GRID} select year, b as band, y as row, x as col, round(v * (b + 1) * 0.01, 6) as v from grid, range(0, 2) as t(b)")
def tiff_bands(spark, d):
    stored = rasters.grids_as_files(year_grid(spark, d), 64, 32, lambda g: rasters.tiff_bytes(np.stack([g, 2 * g])))
    cells = rasters.read_tiff(spark, stored, 0.01).where("v is not null")
    return cells.select(F.col("file").cast("int").alias("year"), F.col("layer").cast("bigint").alias("band"), "row", "col", F.round("v", 6).alias("v"))


@query("kmz_placemarks", "select n_name as name, case when n_nationkey % 2 = 0 then 'Point' else 'Polygon' end as kind, case when n_nationkey % 2 = 0 then [[n_nationkey::double, 1.5]] else [[n_nationkey::double, 1.5], [0.0, 0.0], [1.0, 0.0]] end as coordinates from nation")
def kmz_placemarks(spark, d):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        marks = [("Polygon", n, [(k, 1.5), (0, 0), (1, 0)]) if k % 2 else ("Point", n, [(k, 1.5)]) for k, n in zip(pdf["n_nationkey"], pdf["n_name"], strict=True)]
        return pd.DataFrame({"file": [str(pdf["n_regionkey"].iloc[0])], "content": [rasters.kmz_bytes(marks)]})

    stored = t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").groupBy("n_regionkey").applyInPandas(run, "file string, content binary")
    return rasters.read_kmz(spark, stored).select("name", "kind", "coordinates")


@query("mask_years", "select p_partkey as id, (p_partkey * -10)::int as start, p_size::int as end from part where p_partkey % 2 = 0")
def mask_years(spark, d):
    p = t(spark, d, "part")
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("mask_"), (-10 * F.col("p_partkey")).cast("string"), F.lit("_"), F.col("p_size").cast("string"), F.lit(".png"))).otherwise("other.png")
    return rasters.mask_years(p.select(F.col("p_partkey").alias("id"), name.alias("path"))).drop("path")


# The event log as a stream
EV = "e as (select 'user_' || user_id as id, epoch_us(ts) // 1000 as date, event_type as type, round(value)::bigint::varchar as v from events)"


def logged(spark, d):
    """The events appended to a log, and the log's folder."""
    e = t(spark, d, "events")
    path = place(spark, "log")
    data = F.create_map(F.lit("v"), F.round("value").cast("bigint").cast("string"))
    ontology.append(e.select(F.concat(F.lit("user_"), "user_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("date"), F.col("event_type").alias("type"), data.alias("data")), path)
    return path


@query("log_streamed", f"with {EV} select id, date, type, v from e")
def log_streamed(spark, d):
    """Every entry of the log, drained by the streaming reader in micro-batches."""
    out = place(spark, "drained")
    running = ontology.hydrate(ontology.read_stream(spark, logged(spark, d)), lambda batch, _: batch.write.mode("append").parquet(out), place(spark, "offsets"))
    running.awaitTermination()
    return spark.read.parquet(out).select("id", "date", "type", F.col("data")["v"].alias("v"))


@query("log_latest", f"with {EV} select id, max(date) as date, count(*) as n from e group by 1")
def log_latest(spark, d):
    """Running state per id, the last result of the stream in complete mode."""
    out = place(spark, "latest")

    def keep(batch, _):
        batch.write.mode("overwrite").parquet(out)

    states = ontology.latest_states(ontology.read_stream(spark, logged(spark, d)))
    states.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", place(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("id", "date", "n")


@query("lineage_steps", """with a as (select user_id as timeline, event_id as idx from events), m as (select (select min(user_id) from events) as root),
r as (select 0 as depth, timeline, idx from a, m where timeline = root + 1 union all select 1, timeline, idx from a, m where timeline = root and idx <= 5000) select timeline, idx, row_number() over (order by depth desc, idx) as step from r""")
def lineage_steps(spark, d):
    e = t(spark, d, "events")
    root = e.agg(F.min("user_id")).first()[0]
    actions = e.select(F.col("user_id").cast("string").alias("timeline"), F.col("event_id").alias("idx"))
    lines = entities.branch(actions, spark.createDataFrame([(str(root), None, None)], "id string, parent string, parent_idx bigint"), str(root), 5000, str(root + 1))
    return entities.lineage(actions, lines, str(root + 1)).select(F.col("timeline").cast("bigint").alias("timeline"), "idx", "step")
