"""Queries over whole tables: frames, search, sets, algebra, graphs, entities, the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import maps
from ..operators import entities, frames, graph, linalg
from ..streaming import ontology
from .core import query, r6, t


@query("frame_append", "select s_suppkey as id, s_name as name, s_acctbal as bal, null::varchar as seg from supplier union all select c_custkey, c_name, 0.0, c_mktsegment from customer")
def frame_append(spark, d):
    a = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    b = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"))
    return frames.append(a, b, 0.0)


ROWS = "p as (select row_number() over (order by p_partkey) - 1 as row_idx, p_size::double as Size, p_retailprice as Price from part), s as (select row_number() over (order by s_suppkey) - 1 as row_idx, s_acctbal as Size, s_nationkey::double as Price from supplier)"


def row_frames(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("Size"), F.col("p_retailprice").alias("Price"))
    s = t(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("Size"), F.col("s_nationkey").cast("double").alias("Price"))
    return frames.with_row_index(p, F.col("p_partkey")).drop("p_partkey"), frames.with_row_index(s, F.col("s_suppkey")).drop("s_suppkey")


@query("frame_row_index", f"with {ROWS} select row_idx, Size, Price from p")
def frame_row_index(spark, d):
    return row_frames(spark, d)[0].select("row_idx", "Size", "Price")


@query("frame_operate", f"with {ROWS} select coalesce(p.row_idx, s.row_idx) as row_idx, round(coalesce(p.Size, 0) + coalesce(s.Size, 0) * 2, 6) as Size, round(coalesce(p.Price, 0) - coalesce(s.Price, 0), 6) as Price from p full join s on p.row_idx = s.row_idx")
def frame_operate(spark, d):
    a, b = row_frames(spark, d)
    out = frames.operate(a, b, "i$Size = i$Size + x$Size * 2; i$Price = i$Price - x$Price")
    return out.select("row_idx", r6("Size").alias("Size"), r6("Price").alias("Price"))


@query("frame_operate_all", f"with {ROWS} select coalesce(p.row_idx, s.row_idx) as row_idx, round(coalesce(p.Size, 0) * coalesce(s.Size, 0), 4) as Size, round(coalesce(p.Price, 0) * coalesce(s.Price, 0), 4) as Price from p full join s on p.row_idx = s.row_idx")
def frame_operate_all(spark, d):
    a, b = row_frames(spark, d)
    return frames.operate(a, b, "i * x").select("row_idx", r6("Size", 4).alias("Size"), r6("Price", 4).alias("Price"))


@query("frame_set_row_column", f"with {ROWS} select row_idx, case when row_idx = 3 then -1.0 else Size end as Size, case when row_idx = 3 then -2.0 when row_idx < 100 then row_idx * 1.5 end as Price from p")
def frame_set_row_column(spark, d):
    a, _ = row_frames(spark, d)
    values = spark.range(100).select(F.col("id").alias("row_idx"), (F.col("id") * 1.5).alias("value"))
    row = spark.range(1).select(F.lit(3).cast("bigint").alias("row_idx"), F.lit(-1.0).alias("Size"), F.lit(-2.0).alias("Price"))
    out = frames.set_column(a, "Price", values)
    return frames.set_row(out.select("row_idx", "Size", "Price"), row)


@query("frame_columns", f"with {ROWS} select 'Size' as col, count(*) as n, round(sum(Size), 4) as total from p union all select 'Price', count(*), round(sum(Price), 4) from p")
def frame_columns(spark, d):
    long = frames.to_columns(row_frames(spark, d)[0])
    back = frames.from_columns(long, ["Size", "Price"])
    return back.unpivot(["row_idx"], ["Size", "Price"], "col", "v").groupBy("col").agg(F.count("*").alias("n"), r6(F.sum("v"), 4).alias("total"))


@query("select_column", "select c_mktsegment from customer")
def select_column(spark, d):
    return frames.select_column(t(spark, d, "customer"), "SEGMENT")


@query("table_dimensions", "select 5::bigint as n_columns, count(*) + 1 as n_rows from customer")
def table_dimensions(spark, d):
    return frames.dimensions(t(spark, d, "customer"))


@query("table_search", "select p_partkey, p_name, p_brand from part where lower(p_name) like '%12%' or lower(p_brand) like '%12%' or p_partkey::varchar like '%12%'")
def table_search(spark, d):
    return frames.search(t(spark, d, "part").select("p_partkey", "p_name", "p_brand"), " 12 ")


@query("ranked_search", "select p_partkey, round((case when contains(lower(p_name), 'o') then 1.0 / length(p_name) else 0 end) + (case when contains(lower(p_type), 'o') then 1.0 / length(p_type) else 0 end), 6) as relevance from part where contains(lower(p_name), 'o') or contains(lower(p_type), 'o')")
def ranked_search(spark, d):
    return frames.ranked_search(t(spark, d, "part"), "o", ["p_name", "p_type"]).select("p_partkey", r6("relevance").alias("relevance"))


@query("smart_lookup", "select n_nationkey, 2 as match from nation where lower(n_name) = 'nation_7'")
def smart_lookup(spark, d):
    return frames.smart_lookup(t(spark, d, "nation"), "NATION_7", "n_nationkey", ["n_name"]).select("n_nationkey", "match")


@query("table_page", "select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey limit 25 offset 50")
def table_page(spark, d):
    return frames.page(t(spark, d, "customer").select("c_custkey", "c_acctbal"), 2, 25, F.desc("c_acctbal"), F.asc("c_custkey"))


@query("indexed_view", 'select row_number() over (order by s_suppkey) as "index", s_name from supplier where s_acctbal > 0')
def indexed_view(spark, d):
    return frames.indexed_view(t(spark, d, "supplier"), F.col("s_acctbal") > 0, [F.col("s_suppkey"), F.col("s_name")], F.col("s_suppkey")).select("index", "s_name")


@query("class_tabs", "select distinct c_mktsegment from customer")
def class_tabs(spark, d):
    return t(spark, d, "customer").select("c_mktsegment").distinct()


@query("values_once", "select p_partkey, p_retailprice from part where p_retailprice in (select p_retailprice from part group by 1 having count(*) = 1)")
def values_once(spark, d):
    return frames.without_repeated_values(t(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice").select("p_partkey", "p_retailprice")


@query("shared_places", "with c as (select c_custkey as id, c_custkey % 50 / 7.0 as lat, c_custkey % 30 / 7.0 as lng from customer), n as (select *, count(*) over (partition by round(lat, 4), round(lng, 4)) as k from c) select id, case when k = 1 then round(lat, 6) end as lat, case when k = 1 then round(lng, 6) end as lng from n")
def shared_places(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 50 / 7.0).alias("lat"), (F.col("c_custkey") % 30 / 7.0).alias("lng"))
    return frames.blank_shared_places(c, "lat", "lng").select("id", r6("lat").alias("lat"), r6("lng").alias("lng"))


@query("set_operations", "select 'union' as op, count(*) as n from (select c_nationkey from customer union select s_nationkey from supplier) union all select 'both', count(*) from (select c_nationkey from customer intersect select s_nationkey from supplier) union all select 'only', count(*) from (select c_nationkey from customer except select s_nationkey from supplier)")
def set_operations(spark, d):
    a, b = t(spark, d, "customer").select("c_nationkey"), t(spark, d, "supplier").select("s_nationkey")
    count = lambda df, op: df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    return count(a.union(b).distinct(), "union").union(count(a.intersect(b), "both")).union(count(a.subtract(b), "only"))


@query("workbook_cells", 'with p as (select row_number() over (order by s_suppkey) - 1 as "row", s_name, s_acctbal, s_nationkey from supplier) select "row", 0 as col, s_name as v, 1 as t from p union all select "row", 1, s_nationkey::varchar, 2 from p')
def workbook_cells(spark, d):
    rows = frames.with_row_index(t(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), F.col("s_suppkey"))
    return frames.to_cells(rows, ["s_name", "s_nationkey"]).select("row", "col", "v", "t")


@query("workbook_range", 'with p as (select row_number() over (order by s_suppkey) - 1 as "row", s_name, s_nationkey from supplier) select "row" as series, s_name as label, [s_nationkey::double] as data from p where "row" between 2 and 6')
def workbook_range(spark, d):
    rows = frames.with_row_index(t(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), F.col("s_suppkey"))
    return frames.series_of(frames.to_cells(rows, ["s_name", "s_nationkey"]), 0, (2, 6), (0, 1))


# Algebra
@query("matrix_product", "with m as (select c_nationkey as i, c_custkey % 20 as j, sum(round(c_acctbal)) as v from customer group by 1, 2) select a.i::int as i, b.i::int as j, sum(a.v * b.v) as v from m a join m b on a.j = b.j group by 1, 2")
def matrix_product(spark, d):
    m = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("i"), (F.col("c_custkey") % 20).alias("j")).agg(F.sum(F.round("c_acctbal")).alias("v"))
    return linalg.multiply(m, linalg.transpose(m))


X = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("gram", " union all ".join(f"select {i} as i, {j} as j, round(sum({a} * {b}) / count(*), 4) as v from lineitem" for i, a in enumerate(X) for j, b in enumerate(X)))
def gram(spark, d):
    line = t(spark, d, "lineitem")
    n = line.agg(F.count("*").alias("n"))
    return linalg.gram(line, X).crossJoin(F.broadcast(n)).select("i", "j", r6(F.col("v") / F.col("n"), 4).alias("v"))


@query("ridge", """with s as (select sum(l_quantity * l_quantity) as qq, sum(l_quantity * l_discount) as qd, sum(l_quantity * l_tax) as qt, sum(l_discount * l_discount) as dd, sum(l_discount * l_tax) as dt, sum(l_tax * l_tax) as tt, sum(l_quantity * l_extendedprice) as qy, sum(l_discount * l_extendedprice) as dy, sum(l_tax * l_extendedprice) as ty from lineitem),
g as (select *, qq + 0.001 as a, dd + 0.001 as b, tt + 0.001 as c from s),
i as (select *, a * (b * c - dt * dt) - qd * (qd * c - dt * qt) + qt * (qd * dt - b * qt) as det, qq * (dd * tt - dt * dt) - qd * (qd * tt - dt * qt) + qt * (qd * dt - dd * qt) as plain from g)
select unnest(['l_quantity', 'l_discount', 'l_tax']) as feature,
unnest([round(((b * c - dt * dt) * qy + (qt * dt - qd * c) * dy + (qd * dt - qt * b) * ty) / det, 2), round(((qt * dt - qd * c) * qy + (a * c - qt * qt) * dy + (qd * qt - a * dt) * ty) / det, 2), round(((qd * dt - qt * b) * qy + (qd * qt - a * dt) * dy + (a * b - qd * qd) * ty) / det, 2)]) as weight,
unnest([round((dd * tt - dt * dt) / plain, 10), round((qq * tt - qt * qt) / plain, 10), round((qq * dd - qd * qd) / plain, 10)]) as inflation from i""")
def ridge(spark, d):
    line = t(spark, d, "lineitem")
    w = linalg.ridge(line, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    vif = linalg.variance_inflation(line, ["l_quantity", "l_discount", "l_tax"])
    return spark.createDataFrame([(k, round(v, 2), round(vif[k], 10)) for k, v in w.items()], "feature string, weight double, inflation double")


@query("determinants", "select p_partkey as id, [round(p_size * 4.0 - 6, 6)] as result from part")
def determinants(spark, d):
    m = F.array(F.array(F.col("p_size").cast("double"), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0)))
    out = linalg.dense_kernel(t(spark, d, "part").select(F.col("p_partkey").alias("id"), m.alias("m")), "id", "m", linalg.determinant)
    return out.select("id", F.transform("result", lambda v: F.round(v, 6)).alias("result"))


# Graphs and trees
EDGES = "e as (select s_nationkey as src, c_nationkey as dst, count(*) as cost from lineitem join supplier on l_suppkey = s_suppkey join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by 1, 2)"


def nation_edges(spark, d):
    s = t(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("src"))
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey").join(t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("dst")), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "dst")
    line = t(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    return line.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("src", "dst").agg(F.count("*").alias("cost"))


@query("shortest_paths", f"""with {EDGES}, p0 as (select src as a, dst as b, min(cost)::double as c from (select src, dst, cost from e union all select n_nationkey, n_nationkey, 0 from nation) group by 1, 2),
{", ".join(f"p{i + 1} as (select x.a, y.b, min(x.c + y.c) as c from p{i} x join p{i} y on x.b = y.a group by 1, 2)" for i in range(5))}
select b as node, c as cost from p5 where a = (select min(src) from e)""")
def shortest_paths(spark, d):
    edges = nation_edges(spark, d)
    start = edges.agg(F.min("src")).first()[0]
    return graph.shortest_paths(edges, start).select("node", "cost")


TREE = "tree as (select 'r' || n_regionkey as parent, 'n' || n_nationkey as child, n_nationkey as pos from nation union all select 'n' || s_nationkey, 's' || s_suppkey, s_suppkey from supplier)"


def tree(spark, d):
    n = t(spark, d, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child"), F.col("n_nationkey").cast("bigint").alias("pos"))
    return n.union(t(spark, d, "supplier").select(F.concat(F.lit("n"), "s_nationkey"), F.concat(F.lit("s"), "s_suppkey"), "s_suppkey"))


@query("tree_closure", f"with recursive {TREE}, c as (select parent as ancestor, child as node, 1 as distance from tree union all select c.ancestor, t.child, distance + 1 from c join tree t on t.parent = c.node) select ancestor, node, distance from c")
def tree_closure(spark, d):
    return graph.closure(tree(spark, d))


@query("rendering_order", f"with recursive {TREE}, c as (select 'r0' as node, [0::bigint] as path union all select t.child, list_append(c.path, t.pos::bigint) from c join tree t on t.parent = c.node) select node, path from c")
def rendering_order(spark, d):
    return graph.rendering_order(tree(spark, d), ["r0"])


@query("ancestor_tags", f"with recursive {TREE}, c as (select parent as ancestor, child as node from tree union all select c.ancestor, t.child from c join tree t on t.parent = c.node) select node, list_sort(list(ancestor)) as tags from c group by 1")
def ancestor_tags(spark, d):
    edges = tree(spark, d)
    names = edges.select(F.col("parent").alias("id")).distinct().withColumn("name", F.col("id"))
    return entities.ancestor_tags(edges, names)


@query("command_fold", """with c as (select event_id as idx, user_id as target, event_id % 5 as ts, case when event_type = 'error' then 'remove_keyframe' else 'set_symbol' end as type, case when event_type = 'click' then 'b' else 'a' end as field, round(value) as value from events),
x as (select target, ts, max(idx) filter (type = 'remove_keyframe') as cut from c group by 1, 2),
s as (select c.* from c join x using (target, ts) where type = 'set_symbol' and idx > coalesce(cut, -1))
select target, ts, arg_max(value, idx) filter (field = 'a') as a, arg_max(value, idx) filter (field = 'b') as b from s group by 1, 2""")
def command_fold(spark, d):
    e = t(spark, d, "events")
    kind = F.when(F.col("event_type") == "error", "remove_keyframe").otherwise("set_symbol")
    log = e.select(F.col("event_id").alias("idx"), F.col("user_id").alias("target"), (F.col("event_id") % 5).alias("ts"), kind.alias("type"), F.when(F.col("event_type") == "click", "b").otherwise("a").alias("field"), F.round("value").alias("value"))
    return entities.fold_commands(log, ["a", "b"])


@query("undo_target", """with n as (select user_id as timeline, event_id as idx, event_type as key, case when event_type is distinct from lag(event_type) over w or row_number() over w = 1 then 1 else 0 end as new from events window w as (partition by user_id order by event_id)),
g as (select *, sum(new) over (partition by timeline order by idx) as grp from n), h as (select timeline, arg_max(grp, idx) as grp from g where idx <= 800 group by 1)
select g.timeline, max(g.idx) as idx from g join h on g.timeline = h.timeline and g.grp = h.grp - 1 group by 1""")
def undo_target(spark, d):
    actions = t(spark, d, "events").select(F.col("user_id").alias("timeline"), F.col("event_id").alias("idx"), F.col("event_type").alias("key"))
    return entities.undo_target(actions, 800)


# The event log
def log(spark, d):
    e = t(spark, d, "events")
    key = F.concat(F.lit("k"), F.col("event_id") % 3)
    value = F.when(F.col("event_id") % 11 != 0, F.round("value").cast("bigint").cast("string"))
    return e.select(F.concat(F.lit("user_"), "user_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("date"), F.col("event_type").alias("type"), F.create_map(key, value).alias("data"), "event_id")


LAST = "with e as (select 'user_' || user_id as id, epoch_us(ts) // 1000 as date, event_id, event_id % 3 as k, case when event_id % 11 <> 0 then round(value)::bigint::varchar end as v from events)"


@query("ontology_state", LAST + ", l as (select id, k, arg_max({'v': v}, date).v as v from e group by 1, 2) select id, max(v) filter (k = 0) as k0, max(v) filter (k = 1) as k1, max(v) filter (k = 2) as k2 from l group by 1")
def ontology_state(spark, d):
    final = ontology.states_at(log(spark, d), F.lit(1 << 60))
    return final.select("id", *[F.try_element_at("state", F.lit(f"k{i}")).alias(f"k{i}") for i in range(3)])


@query("ontology_roundtrip", LAST + " select id, count(distinct date) as n, 0::bigint as n_wrong from e group by 1")
def ontology_roundtrip(spark, d):
    states = ontology.snapshots(log(spark, d).drop("event_id"))
    stored = ontology.reverse_differences(states).withColumnRenamed("state", "before")
    same = F.sort_array(F.map_entries("before")) == F.sort_array(F.map_entries("state"))
    return ontology.resolve(stored).groupBy("id").agg(F.count("*").alias("n"), F.count_if(~same).alias("n_wrong"))


@query("ontology_codec", LAST + " select id, count(*) as n, min(date) as first_date, max(date) as last_date from e group by 1")
def ontology_codec(spark, d):
    lines = ontology.encode(log(spark, d)).select("value").union(spark.sql("select 'corrupt {line' as value"))
    return ontology.decode(lines).groupBy("id").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("ontology_nearest", LAST + " select id, arg_min(date, {'d': abs(date - 1705000000000), 't': date}) as date from e group by 1")
def ontology_nearest(spark, d):
    return ontology.nearest_keyframe(log(spark, d), F.lit(1705000000000))


@query("event_age", "select event_id from events where event_type <> 'view' or 1706000000000 - epoch_us(ts) // 1000 <= 48 * 3600000")
def event_age(spark, d):
    e = log(spark, d).withColumn("type", F.when(F.col("type") == "view", "point").otherwise(F.col("type")))
    return ontology.fresh(e, F.lit(1706000000000)).select("event_id")


@query("event_dedupe", "select user_id, event_type, min(event_id) as event_id from events group by 1, 2")
def event_dedupe(spark, d):
    return ontology.first_seen(t(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


@query("ontology_tags", "select user_id, list_sort(list_filter(list_distinct(list_concat(list(distinct event_type), ['new'])), lambda x: x <> 'error')) as tags from events group by 1")
def ontology_tags(spark, d):
    e = t(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("tags"))
    return e.select("user_id", F.sort_array(ontology.apply_mutations(F.col("tags"), F.lit(None).cast("array<string>"), F.array(F.lit("new")), F.array(F.lit("error")))).alias("tags"))


@query("flattened_totals", "select p_brand, round(sum(p_retailprice), 4) as total from part group by 1 having sum(p_retailprice) > 0")
def flattened_totals(spark, d):
    m = t(spark, d, "part").select(F.create_map("p_brand", "p_retailprice").alias("m"))
    return m.select(F.explode(maps.cleaned(F.col("m"))).alias("p_brand", "v")).groupBy("p_brand").agg(r6(F.sum("v"), 4).alias("total"))


@query("top_regions", "select o_custkey, sum(o_totalprice) as total from orders group by 1 order by total desc, o_custkey limit 8")
def top_regions(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total")).orderBy(F.desc("total"), "o_custkey").limit(8)


@query("sort_mixed", "select c_custkey, c_acctbal::varchar as v, row_number() over (order by c_acctbal, c_acctbal::varchar, c_custkey) as n from customer")
def sort_mixed(spark, d):
    rows = t(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("string").alias("v"))
    numbered = frames.with_row_index(rows, *frames.mixed_order("v"), F.col("c_custkey"))
    return numbered.select("c_custkey", "v", (F.col(frames.ROW) + 1).alias("n"))
