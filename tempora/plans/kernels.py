"""Queries over dense matrices, entity and keyframe edits, and small helpers, each against its closed form in SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import arrays, colours, maps, strings
from ..operators import entities, linalg, temporal
from ..streaming import ontology
from .core import query, r6, t

# [[a, 3], [3, 5]] of every part with a = size + 2: symmetric and positive definite
M = "m as (select p_partkey as id, p_size + 2.0::double as a from part)"
DET = "(a * 5 - 9)"


def dense(spark, d, kernel, *rows):
    """The kernel over [[a, 3], [3, 5]], or over the rows given, as rounded numbers."""
    a = F.col("p_size").cast("double") + 2
    number = lambda v: a if v == "a" else F.lit(float(v))
    m = F.array(*[F.array(*map(number, r)) for r in rows or (("a", 3), (3, 5))])
    out = linalg.dense_kernel(t(spark, d, "part").select(F.col("p_partkey").alias("id"), m.alias("m")), "id", "m", kernel)
    return out.select("id", F.transform("result", lambda v: F.round(v, 6) + F.lit(0.0)).alias("result"))


def numbers(*terms: str) -> str:
    return "[" + ", ".join(f"round({x}, 6) + 0.0" for x in terms) + "]"


@query("matrix_inverse", f"with {M} select id, {numbers(f'5 / {DET}', f'-3 / {DET}', f'-3 / {DET}', f'a / {DET}')} as result from m")
def matrix_inverse(spark, d):
    return dense(spark, d, linalg.inverse)


@query("matrix_cholesky", f"with {M} select id, {numbers('sqrt(a)', '0.0', '3 / sqrt(a)', 'sqrt(5 - 9 / a)')} as result from m")
def matrix_cholesky(spark, d):
    return dense(spark, d, linalg.cholesky)


@query("matrix_lu", f"with {M} select id, {numbers('1.0', '0.0', '3 / a', '1.0', 'a', '3.0', '0.0', '5 - 9 / a')} as result from m")
def matrix_lu(spark, d):
    return dense(spark, d, lambda m: np.concatenate([x.ravel() for x in linalg.lu(m)]))


@query("matrix_qr", f"with {M}, n as (select id, a, sqrt(a * a + 9) as r from m) select id, {numbers('a / r', '-3 / r', '3 / r', 'a / r', 'r', '(3 * a + 15) / r', '0.0', '(5 * a - 9) / r')} as result from n")
def matrix_qr(spark, d):
    return dense(spark, d, lambda m: np.concatenate([x.ravel() for x in linalg.qr(m)]))


@query("linear_systems", f"with {M} select id, {numbers(*[f'(5 * 1 - 3 * 2) / {DET}', f'(a * 2 - 3 * 1) / {DET}'] * 2)} as result from m")
def linear_systems(spark, d):
    """Elimination and least squares on [[a, 3, 1], [3, 5, 2]]."""
    both = lambda m: np.concatenate([linalg.solve(m), linalg.least_squares([r[:2] for r in m], [r[2] for r in m])])
    return dense(spark, d, both, ("a", 3, 1), (3, 5, 2))


@query("relaxed_systems", "with m as (select p_partkey as id, p_size + 2.0::double as a from part) select id, list_transform([1, 2, 3], lambda k: [round((9 - 2) / (9 * (a + 9) - 1), 4), round((2 * (a + 9) - 1) / (9 * (a + 9) - 1), 4)]) as result from m")
def relaxed_systems(spark, d):
    """Jacobi, Gauss-Seidel and over-relaxation on [[a + 9, 1], [1, 9]] x = [1, 2]."""

    def all_three(m):
        a, b = np.array(m)[:, :2] + [[9, 0], [0, 0]], [1, 2]
        return np.concatenate([linalg.relax(a, b, tolerance=1e-12), linalg.relax(a, b, "seidel", 1.0, 1e-12), linalg.relax(a, b, "seidel", 1.1, 1e-12)])

    out = dense(spark, d, all_three, ("a", 1), (1, 9))
    near = lambda i: F.array(F.round(F.col("result")[i], 4), F.round(F.col("result")[i + 1], 4))
    return out.select("id", F.array(near(0), near(2), near(4)).alias("result"))


@query("householder", f"with {M} select id, {numbers('a', '-5.0', '0.0', '-5.0', '(9 * 2 + 16 * 6 + 2 * 12 * 1) / 25.0', '(9 * 1 - 16 * 1 + 12 * (6 - 2)) / 25.0 * -1', '0.0', '(9 * 1 - 16 * 1 + 12 * (6 - 2)) / 25.0 * -1', '(16 * 2 + 9 * 6 - 2 * 12 * 1) / 25.0')} as result from m")
def householder(spark, d):
    """[[a, 3, 4], [3, 2, 1], [4, 1, 6]] made tridiagonal by one reflection; the sign of the last off-diagonal pair is made that of the SQL."""

    def kernel(m):
        out = linalg.tridiagonal(m)
        sign = -np.sign(out[1, 2]) or 1.0
        out[1, 2] *= sign
        out[2, 1] *= sign
        return out

    return dense(spark, d, kernel, ("a", 3, 4), (3, 2, 1), (4, 1, 6))


@query("matrix_sum", "with c as (select l_suppkey % 7 as i, l_partkey % 5 as j, sum(l_quantity) as v from lineitem group by 1, 2), u as (select i, j, v from c union all select j, i, -v from c) select i, j, round(sum(v), 4) as v from u group by 1, 2")
def matrix_sum(spark, d):
    c = t(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 7).alias("i"), (F.col("l_partkey") % 5).alias("j")).agg(F.sum("l_quantity").alias("v"))
    return linalg.add(c, linalg.transpose(c), -1).select("i", "j", r6("v", 4).alias("v"))


@query("ridge_pair", """with g as (select sum(l_quantity * l_quantity) + 0.001 as a, sum(l_quantity * l_tax) as b, sum(l_tax * l_tax) + 0.001 as c, sum(l_quantity * l_extendedprice) as y, sum(l_tax * l_extendedprice) as z, sum(l_quantity * l_quantity) as a0, sum(l_tax * l_tax) as c0 from lineitem)
select unnest(['l_quantity', 'l_tax']) as feature, unnest([round((c * y - b * z) / (a * c - b * b), 3), round((a * z - b * y) / (a * c - b * b), 3)]) as weight, unnest([round(c0 / (a0 * c0 - b * b), 12), round(a0 / (a0 * c0 - b * b), 12)]) as inflation,
round(sqrt(((a0 + c0) / 2 + sqrt(((a0 - c0) / 2) ** 2 + b * b)) / ((a0 + c0) / 2 - sqrt(((a0 - c0) / 2) ** 2 + b * b))), 1) as condition, (c0 / (a0 * c0 - b * b) < 10)::int + (a0 / (a0 * c0 - b * b) < 10)::int as kept from g""")
def ridge_pair(spark, d):
    line, names = t(spark, d, "lineitem"), ["l_quantity", "l_tax"]
    w, vif = linalg.ridge(line, names, "l_extendedprice"), linalg.variance_inflation(line, names)
    condition, kept = linalg.condition_number(line, names), len(linalg.without_inflated(line, names))
    return spark.createDataFrame([(k, round(w[k], 3), round(vif[k], 12), round(condition, 1), kept) for k in names], "feature string, weight double, inflation double, condition double, kept int")


# Entities: regions hold nations, nations hold suppliers
TREE = "e as (select 'r' || n_regionkey as parent, 'n' || n_nationkey as child, n_nationkey as pos from nation union all select 'n' || s_nationkey, 's' || s_suppkey, s_suppkey from supplier), x as (select parent as id from e union select child from e), b as (select 'r1' as id union all select child from e where parent = 'r1' union all select f.child from e join e f on f.parent = e.child where e.parent = 'r1')"


def tree(spark, d):
    n = t(spark, d, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child"), F.col("n_nationkey").cast("bigint").alias("pos"))
    return n.union(t(spark, d, "supplier").select(F.concat(F.lit("n"), "s_nationkey"), F.concat(F.lit("s"), "s_suppkey"), F.col("s_suppkey").cast("bigint")))


def things(edges):
    return edges.select(F.col("parent").alias("id")).union(edges.select("child")).distinct()


@query("subtree_hidden", f"with {TREE} select id, id in (select id from b) as hidden from x")
def subtree_hidden(spark, d):
    edges = tree(spark, d)
    return entities.set_hidden(things(edges).withColumn("hidden", F.lit(False)), edges, "r1", True)


@query("subtree_deleted", f"with {TREE} select 'entity' as what, id from x where id not in (select id from b) union all select 'edge', child from e where child not in (select id from b)")
def subtree_deleted(spark, d):
    edges = tree(spark, d)
    left, kept = entities.delete(things(edges), edges, "r1")
    return left.select(F.lit("entity").alias("what"), "id").union(kept.select(F.lit("edge"), "child"))


@query("subtree_members", f"with {TREE} select 'r1' as ancestor, child as node, 1 as distance from e where parent = 'r1' union all select 'r1', f.child, 2 from e join e f on f.parent = e.child where e.parent = 'r1'")
def subtree_members(spark, d):
    return entities.descendants(tree(spark, d), spark.createDataFrame([("r1",)], "id string"))


@query("member_moved", f"with {TREE} select parent, child, pos from e where child <> 'n7' union all select 'r4', 'n7', max(pos) + 1 from e where parent = 'r4'")
def member_moved(spark, d):
    return entities.add_member(tree(spark, d), "r4", "n7")


@query("visible_entities", "select p_partkey as id from part where p_size % 3 <> 0 and p_partkey % 4 <> 0 and 5 between p_size % 8 and 10")
def visible_entities(spark, d):
    p, size = t(spark, d, "part"), F.col("p_size")
    rows = p.select(F.col("p_partkey").alias("id"), F.when(size % 3 != 0, "shape").alias("geometry"), F.when(F.col("p_partkey") % 4 == 0, True).alias("hidden"), (size % 8).cast("double").alias("min_zoom"), F.lit(10.0).alias("max_zoom"))
    return entities.visible(rows, 5.0).select("id")


@query("bulk_commands", "select 77::bigint as idx, 'c' || c_custkey as target, c_custkey as ts, 'set_symbol' as type, 'colour' as field, c_mktsegment as value from customer")
def bulk_commands(spark, d):
    c = t(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), "c_custkey", "c_mktsegment")
    return entities.bulk_command(c, 77, "set_symbol", "colour", F.col("c_mktsegment"), F.col("c_custkey"))


@query("keyframes_edited", "select o_custkey as entity, case when o_orderkey % 5 = 0 then o_orderkey + 1000000 else o_orderkey end as ts, o_orderstatus as v from orders where o_orderkey % 7 <> 0")
def keyframes_edited(spark, d):
    h = t(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("ts"), F.col("o_orderstatus").alias("v"))
    kept = temporal.remove(h, h.where("ts % 7 = 0"), ["entity", "ts"])
    return temporal.move(kept, "entity", "ts", h.where("ts % 5 = 0").select("entity", F.col("ts").alias("from"), (F.col("ts") + 1_000_000).alias("to")))


@query("keyframe_dates", "select distinct o_orderdate as ts from orders join customer on o_custkey = c_custkey where c_nationkey = 3")
def keyframe_dates(spark, d):
    h = t(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderdate").alias("ts"))
    return entities.keyframe_dates(h, t(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("id")), "entity", "ts")


@query("geocoded", "with g as (select lower(p_name) as k, arg_max({'lat': p_size::double, 'lng': p_retailprice}, {'n': p_partkey % 50, 'lat': p_size, 'lng': p_retailprice}) as p from part group by 1) select p_partkey as id, coalesce(p.lat, 0) as lat, coalesce(p.lng, 0) as lng from part left join g on k = lower(case when p_partkey % 9 = 0 then 'nowhere' else p_name end)")
def geocoded(spark, d):
    p = t(spark, d, "part")
    names = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 9 == 0, "nowhere").otherwise(F.concat(F.lit(" "), F.upper("p_name"))).alias("city"))
    places = p.select(F.col("p_name").alias("name"), F.col("p_size").cast("double").alias("lat"), F.col("p_retailprice").alias("lng"), (F.col("p_partkey") % 50).alias("population"))
    return entities.geocode(names, places, "city").drop("city")


@query("log_edited", "with e as (select 'user_' || user_id as id, case when event_id % 4 = 0 then epoch_us(ts) // 1000 + 10000000000 else epoch_us(ts) // 1000 end as date, round(value)::bigint::varchar as v from events where event_id % 6 <> 0) select id, count(distinct date) as n, max(date) as last_date, arg_max(v, date) as v from e group by 1")
def log_edited(spark, d):
    """Keyframes deleted and moved, then the history folded anew; the newest state and how many there are."""
    e = t(spark, d, "events").select(F.concat(F.lit("user_"), "user_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("date"), F.col("event_type").alias("type"), F.create_map(F.lit("v"), F.round("value").cast("bigint").cast("string")).alias("data"), "event_id")
    left = ontology.delete_keyframes(e, e.where("event_id % 6 = 0"))
    moved = ontology.move_keyframes(left, e.where("event_id % 4 = 0").select("id", "date", (F.col("date") + 10_000_000_000).alias("to"))).drop("event_id")
    stored = ontology.resolve(ontology.reverse_differences(ontology.snapshots(moved)).drop("state"))
    return stored.groupBy("id").agg(F.count("*").alias("n"), F.max("date").alias("last_date"), F.max_by(F.col("state")["v"], "date").alias("v"))


# Helpers
@query("type_checks", "select p_partkey as id, true as numbers, false as mixed, p_partkey % 2 = 0 as header, round(radians(p_size), 6) as radians, round(degrees(p_size / 10.0), 6) as degrees from part")
def type_checks(spark, d):
    size, name = F.col("p_size").cast("string"), F.col("p_name")
    first = F.array(name, F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(size))
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), arrays.is_type(F.array(size, F.lit("1e3")), "number").alias("numbers"), arrays.is_type(F.array(size, name), "number").alias("mixed"), arrays.has_header(first).alias("header"), r6(F.radians("p_size")).alias("radians"), r6(F.degrees(F.col("p_size") / 10)).alias("degrees"))


@query("nested_documents", """select p_partkey as id, ['a', 'b', 'c', 'd'] as keys, ['a', 'c'] as objects, '{"name":"' || p_name || '","size":' || p_size || ',"none":null}' as text, [p_name, p_type] as values, p_size = 5 as same from part""")
def nested_documents(spark, d):
    doc = F.concat(F.lit('{"a": {"b": "x: \\"y\\" {", "c": {"d": '), F.col("p_size").cast("string"), F.lit("}}}"))
    whole = F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.lit(None).cast("string").alias("none"))
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), maps.sub_keys(doc).alias("keys"), maps.sub_keys(doc, True).alias("objects"), maps.serialise(whole).alias("text"), maps.values_list(F.create_map(F.lit("n"), "p_name", F.lit("t"), "p_type")).alias("values"), maps.strictly_equal(F.col("p_size"), F.lit(5)).alias("same"))


@query("printed_tokens", "select p_partkey as id, ['number', 'string', 'boolean', 'null', 'number'] as kinds, [p_size::varchar, p_name, 'TRUE', 'NA', '2.5'] as texts from part")
def printed_tokens(spark, d):
    out = F.concat(F.lit("[1] "), F.col("p_size").cast("string"), F.lit(' "'), "p_name", F.lit('" TRUE\n [4] NA  2.5'))
    tokens = strings.printed_tokens(out)
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.transform(tokens, lambda k: k["kind"]).alias("kinds"), F.transform(tokens, lambda k: k["text"]).alias("texts"))


@query("colours_parsed", "select p_partkey as id, [p_size, 16.0, 255.0, 1.0]::double[] as long, [17.0, 34.0, 51.0, round(68 / 255.0, 4)]::double[] as short, [p_size, 2.0, 3.0, 0.5]::double[] as called, [0.0, 128.0, 0.0, 1.0]::double[] as named, null::double[] as none from part")
def colours_parsed(spark, d):
    size = F.col("p_size")
    c = lambda x: colours.parse_colour(x, {"green": "#008000"})
    long = F.concat(F.lit("#"), F.lpad(F.hex(size.cast("bigint")), 2, "0"), F.lit("10ff"))
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), c(long).alias("long"), c(F.lit("#1234")).alias("short"), c(F.concat(F.lit("rgba("), size.cast("string"), F.lit(", 2, 3, .5)"))).alias("called"), c(F.lit(" Green")).alias("named"), c(F.lit("no colour")).alias("none"))
