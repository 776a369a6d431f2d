"""Queries over the Column libraries: arrays, maps, numbers, ranges, colours, text, dates, equations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..equation import compile_assignments, compile_expression
from ..functions import arrays, colours, dates, geo, maps, maths, strings
from .core import query, r6, t

A = "a as (select p_partkey as id, [p_size::double, p_retailprice, (p_partkey % 7)::double, (-(p_partkey % 5))::double] as a, [1.0, p_size::double, 2.0] as b from part)"


def pairs(spark, d):
    p = t(spark, d, "part")
    dbl = lambda c: c.cast("double")
    a = F.array(dbl(F.col("p_size")), F.col("p_retailprice"), dbl(F.col("p_partkey") % 7), dbl(-(F.col("p_partkey") % 5)))
    return p.select(F.col("p_partkey").alias("id"), a.alias("a"), F.array(F.lit(1.0), dbl(F.col("p_size")), F.lit(2.0)).alias("b"))


def rounded(a):
    return F.transform(a, lambda v: F.round(v, 6))


@query("array_operate", f"with {A} select id, list_transform(a, lambda n: round(n * 2 + n ** 2 / 4 - 1, 6)) as r from a")
def array_operate(spark, d):
    return pairs(spark, d).select("id", rounded(arrays.operate(F.col("a"), "n * 2 + n ** 2 / 4 - 1")).alias("r"))


@query("array_operate_pairs", f"with {A} select id, list_transform([1, 2, 3, 4], lambda k: round(a[k] * coalesce(b[k], 0) + 1, 6)) as r from a")
def array_operate_pairs(spark, d):
    return pairs(spark, d).select("id", rounded(arrays.operate_arrays(F.col("a"), F.col("b"), "i * x + 1")).alias("r"))


@query("array_arithmetic", f"""with {A} select id, list_transform(a, lambda n: round(n + 3, 6)) as plus, list_transform(a, lambda n: round(n / 4, 6)) as over, list_transform(a, lambda n: round(sign(n) * pow(abs(n), 1.0 / 3), 6)) as root, list_transform(a, lambda n: abs(n)) as absolute,
list_transform([1, 2, 3, 4], lambda k: round(a[k] - coalesce(b[k], 0), 6)) as minus from a""")
def array_arithmetic(spark, d):
    a, b = F.col("a"), F.col("b")
    return pairs(spark, d).select("id", rounded(arrays.arithmetic(a, "add", 3)).alias("plus"), rounded(arrays.arithmetic(a, "divide", 4)).alias("over"), rounded(arrays.arithmetic(a, "root", 3)).alias("root"), arrays.absolute(a).alias("absolute"), rounded(arrays.arithmetic_arrays(a, b, "subtract")).alias("minus"))


@query("array_summaries", f"""with {A} select id, round(list_avg(a), 6) as average, round(list_sum(a), 6) as total, list_max(a) as most, list_min(a) as least, round((list_max(a) + list_min(a)) / 2, 6) as middle, len(a)::int as n, len(list_distinct(a))::int as n_distinct from a""")
def array_summaries(spark, d):
    a = F.col("a")
    return pairs(spark, d).select("id", r6(arrays.average(a)).alias("average"), r6(arrays.total(a)).alias("total"), F.array_max(a).alias("most"), F.array_min(a).alias("least"), r6(arrays.midpoint(a)).alias("middle"), arrays.cardinality(a).alias("n"), F.size(arrays.unique(a)).alias("n_distinct"))


@query("array_search", f"""with {A} select id, list_filter(a, lambda v: v >= 0 and v <= 30) as within, list_filter(a, lambda v: v < 0 or v > 1000) as outside, [a[2], a[4]] as picked, greatest(list_min(a), least(list_max(a), 5.0)) as clamped from a""")
def array_search(spark, d):
    a = F.col("a")
    return pairs(spark, d).select("id", arrays.elements(a, geq=0, leq=30).alias("within"), arrays.elements(a, not_range=(0, 1000)).alias("outside"), arrays.pick(a, [1, 3]).alias("picked"), arrays.clamp_to_domain(a, F.lit(5.0)).alias("clamped"))


@query("array_closest", f"with {A}, u as (select id, unnest(a) as v, generate_subscripts(a, 1) as i from a) select id, arg_min(v, {{'d': abs(v - 4), 'i': i}}) as closest from u group by id")
def array_closest(spark, d):
    return pairs(spark, d).select("id", arrays.closest(F.col("a"), F.lit(4.0)).alias("closest"))


@query("array_shape", f"""with {A} select id, [[a[1], a[2]], [a[3], a[4]]] as folded, [a[2], a[3], a[1], a[4]] as moved, list_reverse(a) as reversed, list_concat(a, b) as joined, a[1:2] as cut, list_sort(a) as ordered from a""")
def array_shape(spark, d):
    a = F.col("a")
    return pairs(spark, d).select("id", arrays.reshape(a, 2).alias("folded"), arrays.move(a, 0, 2).alias("moved"), arrays.reverse(a).alias("reversed"), arrays.append(a, F.col("b")).alias("joined"), arrays.truncate(a, 2).alias("cut"), arrays.sort_by(a, "ascending").alias("ordered"))


@query("array_bracket", f"with {A}, s as (select id, list_sort(list_distinct(a)) as k from a), p as (select id, k, greatest(least(len(list_filter(k, lambda v: v <= 3)), len(k) - 1), 1) as i from s) select id, case when len(k) >= 2 then [k[i], k[i + 1]] end as bracket from p")
def array_bracket(spark, d):
    return pairs(spark, d).select("id", arrays.bracket(F.col("a"), F.lit(3.0)).alias("bracket"))


@query("array_generators", "select i as id, list_transform(range(0, i + 1), lambda n: n::int) as domain, list_transform(range(0, 5), lambda n: round(2 + n * 0.5, 6)) as steps, list_transform(range(0, 4), lambda n: (n * n + 1)::double) as squares from range(0, 20) as t(i)")
def array_generators(spark, d):
    return spark.range(20).select("id", arrays.filled_domain(F.lit(0), F.col("id")).alias("domain"), rounded(arrays.linear_sequence(2, 4, 0.5)).alias("steps"), arrays.generated(4, "n * n + 1").alias("squares"))


@query("lagrange", f"with {A} select id, round(a[1] * ((6.0 - 2) / (1.0 - 2)) * ((6.0 - 4) / (1.0 - 4)) + a[2] * ((6.0 - 1) / (2.0 - 1)) * ((6.0 - 4) / (2.0 - 4)) + a[3] * ((6.0 - 1) / (4.0 - 1)) * ((6.0 - 2) / (4.0 - 2)), 4) as y from a")
def lagrange(spark, d):
    xs = F.array(F.lit(1.0), F.lit(2.0), F.lit(4.0))
    return pairs(spark, d).select("id", r6(arrays.lagrange(xs, F.slice("a", 1, 3), F.lit(6.0)), 4).alias("y"))


@query("linear_extrapolate", "select p_partkey as id, round(p_size + (2.0 - 1) * (p_retailprice - p_size) / 3, 6) as inside, round(p_size * exp((ln(p_retailprice) - ln(p_size)) / 3 * (5.0 - 1)), 2) as beyond from part where p_size > 0")
def linear_extrapolate(spark, d):
    p = t(spark, d, "part").where("p_size > 0").select(F.col("p_partkey").alias("id"), F.array(F.lit(1.0), F.lit(4.0)).alias("x"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("y"))
    return p.select("id", r6(arrays.linear(F.col("x"), F.col("y"), F.lit(2.0))).alias("inside"), r6(arrays.linear(F.col("x"), F.col("y"), F.lit(5.0)), 2).alias("beyond"))


# Maps
M = "m as (select p_partkey as id, p_size::double as x, p_retailprice as y, (p_partkey % 9)::double as z from part)"


def two_maps(spark, d):
    p = t(spark, d, "part")
    x, y, z = F.col("p_size").cast("double"), F.col("p_retailprice"), (F.col("p_partkey") % 9).cast("double")
    return p.select(F.col("p_partkey").alias("id"), F.create_map(F.lit("x"), x, F.lit("y"), y).alias("a"), F.create_map(F.lit("y"), z, F.lit("z"), z).alias("b"))


def values(m, *keys):
    return F.array(*[F.round(F.element_at(m, k), 6) for k in keys])


@query("map_operate", f"with {M} select id, [round(x * 2 + 1, 6), round(y * 2 + 1, 6)] as r from m")
def map_operate(spark, d):
    return two_maps(spark, d).select("id", values(maps.operate(F.col("a"), "n * 2 + 1"), "x", "y").alias("r"))


@query("map_operate_pairs", f"with {M} select id, [round(x - 0, 6), round(y - z, 6), round(0 - z, 6)] as r, [round(x, 6), round(y + z, 6), round(z, 6)] as merged, [round(x, 6), round(z, 6), round(z, 6)] as over from m")
def map_operate_pairs(spark, d):
    a, b = F.col("a"), F.col("b")
    return two_maps(spark, d).select("id", values(maps.operate_maps(a, b, "i - x"), "x", "y", "z").alias("r"), values(maps.merge(a, b), "x", "y", "z").alias("merged"), values(maps.merge(a, b, "overwrite"), "x", "y", "z").alias("over"))


@query("map_summaries", f"with {M} select id, round(x + y, 6) as total, greatest(x, y) as most, least(x, y) as least, [round(x / greatest(x, y), 6), round(y / greatest(x, y), 6)] as fraction, [round(x / (x + y) * 100, 6), round(y / (x + y) * 100, 6)] as share from m")
def map_summaries(spark, d):
    a = F.col("a")
    return two_maps(spark, d).select("id", r6(maps.total(a)).alias("total"), maps.maximum(a).alias("most"), maps.minimum(a).alias("least"), values(maps.as_fraction(a), "x", "y").alias("fraction"), values(maps.as_share(a), "x", "y").alias("share"))


@query("map_difference", f"with {M} select id, (y is distinct from z)::int + 2 as n_changed, round(x, 6) as back_x, round(y, 6) as back_y, 2 as n_back from m")
def map_difference(spark, d):
    diff = maps.negative_difference(F.col("a"), F.col("b"))
    back = maps.apply_difference(F.col("b"), diff)
    return two_maps(spark, d).select("id", F.size(diff).alias("n_changed"), F.round(F.element_at(back, "x"), 6).alias("back_x"), F.round(F.element_at(back, "y"), 6).alias("back_y"), F.size(back).alias("n_back"))


@query("map_entries_sorted", f"with {M} select id, case when x <= y then ['x', 'y'] else ['y', 'x'] end as by_value, [0.0, 1.0] as domain from m where x <> y")
def map_entries_sorted(spark, d):
    order = F.transform(maps.sorted_entries(F.col("a"), "value"), lambda e: e["key"])
    numbered = arrays.to_map(F.array(F.lit(5), F.lit(6)))
    return two_maps(spark, d).where("a['x'] <> a['y']").select("id", order.alias("by_value"), maps.domain(numbered).alias("domain"))


@query("map_nearest_signed", "select p_partkey as id, case when abs(10 - p_size) < abs(20 - p_size) then 1.0 else 3.0 end as near_positive, -2.0 as near_negative from part")
def map_nearest_signed(spark, d):
    m = F.create_map(F.lit("10"), F.lit(1.0), F.lit("15"), F.lit(-2.0), F.lit("20"), F.lit(3.0))
    key = F.col("p_size").cast("double")
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), maps.nearest_signed(m, key).alias("near_positive"), maps.nearest_signed(m, key, False).alias("near_negative"))


@query("json_values", "select event_id, json_extract_string(props, '$.k') as k, 1 as depth from events")
def json_values(spark, d):
    return t(spark, d, "events").select("event_id", maps.json_path(F.col("props"), "k").alias("k"), maps.depth(F.col("props")).alias("depth"))


# Numbers and ranges
@query("number_formats", """select p_partkey as id, case when p_partkey % 100 between 11 and 13 then p_partkey || 'th' when p_partkey % 10 = 1 then p_partkey || 'st' when p_partkey % 10 = 2 then p_partkey || 'nd' when p_partkey % 10 = 3 then p_partkey || 'rd' else p_partkey || 'th' end as ordinal,
p_partkey::int as number, translate(p_partkey::varchar, '0123456789', 'abcdefghij') as letters, p_partkey::double as digits, case when p_partkey % 9 = 0 then 1.0 else (p_partkey % 9)::double end as unzeroed from part""")
def number_formats(spark, d):
    n = F.col("p_partkey")
    return t(spark, d, "part").select(n.alias("id"), maths.ordinal(n).alias("ordinal"), maths.deordinal(maths.ordinal(n)).alias("number"), maths.alphabetise(n).alias("letters"), maths.numerise(maths.alphabetise(n)).alias("digits"), maths.unzero((n % 9).cast("double")).alias("unzeroed"))


@query("number_functions", "select p_partkey as id, round(sign(p_retailprice) * floor(abs(p_retailprice) * pow(10, 2 - floor(log10(abs(p_retailprice)))) + 0.5) / pow(10, 2 - floor(log10(abs(p_retailprice)))), 6) as sig, round(ln(p_retailprice) / ln(3), 6) as log3, round(pow(p_retailprice, 1.0 / 3), 6) as cube, round(list_sum(list_transform(range(1, p_partkey % 9 + 2), lambda i: ln(i))), 6) as log_factorial from part")
def number_functions(spark, d):
    v, n = F.col("p_retailprice"), F.col("p_partkey") % 9 + 1
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), r6(maths.sigfig(v, 3)).alias("sig"), r6(maths.logarithm(F.lit(3.0), v)).alias("log3"), r6(maths.root(v, 3)).alias("cube"), r6(maths.log_factorial(n)).alias("log_factorial"))


@query("range_functions", "select p_partkey as id, [least(p_size, p_retailprice) + 2, greatest(p_size, p_retailprice) + 2] as plus, round((p_size + p_retailprice) / 2, 6) as middle, list_sort([round(least(p_size, p_retailprice) * -3, 6), round(greatest(p_size, p_retailprice) * 5, 6)]) as product from part")
def range_functions(spark, d):
    r = maths.as_range(F.col("p_size").cast("double"), F.col("p_retailprice"))
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), maths.range_scalar(r, "add", 2).alias("plus"), r6(maths.range_midpoint(r)).alias("middle"), rounded(maths.range_range(r, F.array(F.lit(-3.0), F.lit(5.0)), "multiply")).alias("product"))


@query("geometric_mean", "select p_partkey as id, round(pow(p_size * p_retailprice, 0.5), 6) as g from part")
def geometric_mean(spark, d):
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), r6(maths.geometric_mean(F.array(F.col("p_size").cast("double"), F.col("p_retailprice")))).alias("g"))


@query("easing", "select i as id, round((i / 20.0) ** 2, 6) as quad, round(1 - (1 - i / 20.0) ** 3, 6) as cubic, round(case when i / 20.0 < 0.5 then (1 - cos(i / 10.0 * pi() / 2)) / 2 else 1 - (1 - cos((2 - i / 10.0) * pi() / 2)) / 2 end, 6) as wave from range(0, 21) as t(i)")
def easing(spark, d):
    x = F.col("id") / 20
    return spark.range(21).select("id", r6(maths.ease(x, "quadraticIn")).alias("quad"), r6(maths.ease(x, "cubicOut")).alias("cubic"), r6(maths.ease(x, "sinusoidalInOut")).alias("wave"))


# Colours
@query("colour_bytes", "select p_partkey as id, [(v >> 24) & 255, (v >> 16) & 255, (v >> 8) & 255, v & 255]::int[] as rgba, v::double as back from (select p_partkey, ceil(p_retailprice * 12345.678)::bigint as v from part)")
def colour_bytes(spark, d):
    p = colours.encode_rgba(F.col("p_retailprice") * 12345.678)
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), p.alias("rgba"), colours.decode_rgba(p).alias("back"))


RGB = "c as (select p_partkey as id, (p_partkey * 37 % 256)::int as r, (p_partkey * 91 % 256)::int as g, (p_partkey * 53 % 256)::int as b from part)"


def rgb(spark, d):
    k = F.col("p_partkey")
    return t(spark, d, "part").select(k.alias("id"), *[(k * m % 256).cast("int").alias(n) for n, m in (("r", 37), ("g", 91), ("b", 53))])


@query("colour_hex", f"with {RGB} select id, '#' || lpad(lower(to_hex(r)), 2, '0') || lpad(lower(to_hex(g)), 2, '0') || lpad(lower(to_hex(b)), 2, '0') as hex, [r, g, b]::double[] as back from c")
def colour_hex(spark, d):
    h = colours.rgb_to_hex(F.col("r"), F.col("g"), F.col("b"))
    return rgb(spark, d).select("id", h.alias("hex"), colours.hex_to_rgb(h).alias("back"))


def _linear_sql(c: str, edge: str) -> str:
    return f"case when {c} / 255.0 > {edge} then pow(({c} / 255.0 + 0.055) / 1.055, 2.4) else {c} / 255.0 / 12.92 end"


@query("colour_luminance", f"with {RGB}, l as (select id, 0.2126 * ({_linear_sql('r', '0.03928')}) + 0.7152 * ({_linear_sql('g', '0.03928')}) + 0.0722 * ({_linear_sql('b', '0.03928')}) as y from c) select id, round(y, 6) as luminance, case when y > 0.179 then 'black' else 'white' end as text from l")
def colour_luminance(spark, d):
    c = [F.col(x) for x in "rgb"]
    return rgb(spark, d).select("id", r6(colours.luminance(*c)).alias("luminance"), colours.text_colour(*c).alias("text"))


def _f(x: str) -> str:
    return f"case when {x} > 0.008856 then pow({x}, 1.0 / 3) else 7.787 * {x} + 16.0 / 116 end"


@query("colour_lab", f"""with {RGB}, s as (select id, {_linear_sql('r', '0.04045')} as r, {_linear_sql('g', '0.04045')} as g, {_linear_sql('b', '0.04045')} as b from c),
x as (select id, (0.4124 * r + 0.3576 * g + 0.1805 * b) / 0.95047 as x, 0.2126 * r + 0.7152 * g + 0.0722 * b as y, (0.0193 * r + 0.1192 * g + 0.9505 * b) / 1.08883 as z from s),
f as (select id, {_f('x')} as x, {_f('y')} as y, {_f('z')} as z from x), lab as (select id, 116 * y - 16 as l, 500 * (x - y) as a, 200 * (y - z) as b from f),
d as (select id, l, a, b, l - 50 as dl, a - 10 as da, b + 10 as db, sqrt(a * a + b * b) as c1, sqrt(200.0) as c2 from lab)
select id, [round(l, 4), round(a, 4), round(b, 4)] as lab, round(sqrt(dl * dl + pow((c1 - c2) / (1 + 0.045 * c1), 2) + greatest(da * da + db * db - (c1 - c2) * (c1 - c2), 0) / pow(1 + 0.015 * c1, 2)), 4) as delta_e from d""")
def colour_lab(spark, d):
    lab = colours.to_lab(*[F.col(x) for x in "rgb"])
    other = F.array(F.lit(50.0), F.lit(10.0), F.lit(-10.0))
    return rgb(spark, d).select("id", F.transform(lab, lambda v: F.round(v, 4)).alias("lab"), r6(colours.delta_e(lab, other), 4).alias("delta_e"))


# Text
@query("text_formats", """select p_partkey as id, regexp_replace(p_name, '[^0-9]', '', 'g') as digits, case when length(p_name) > 8 then substring(p_name, 1, 8) || ' ...' else p_name end as short, lower(trim(p_name)) = lower(p_name) as same, case when p_size > 25 then 'Yes' else 'No' end as yes,
replace(replace(replace(p_type, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as escaped, [substring(p_name, 1, 3), substring(p_name, 4)] as parts from part""")
def text_formats(spark, d):
    n = F.col("p_name")
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), strings.digits(n).alias("digits"), strings.ellipsis(n, 8).alias("short"), strings.equals_ignore_case(F.trim(n), n).alias("same"), strings.yes_no(F.col("p_size") > 25).alias("yes"), strings.escape_html(F.col("p_type")).alias("escaped"), strings.split_at(n, 3).alias("parts"))


@query("european_numbers", "select p_partkey as id, round(p_retailprice * 1000, 1) as v from part")
def european_numbers(spark, d):
    text = maths.german(F.round(F.col("p_retailprice") * 1000, 1), 1)
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), strings.european_number(text).alias("v"))


@query("list_texts", "select case when n = 1 then 'a' when n = 2 then 'a and b' when n = 3 then 'a, b, and c' else '' end as text, n from range(0, 4) as t(n)")
def list_texts(spark, d):
    return spark.range(4).select(strings.list_text(F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 1, F.col("id").cast("int"))).alias("text"), F.col("id").alias("n"))


@query("rolling_hash", "with c as (select doc_id, list_transform(string_split(text, ''), lambda c: unicode(c)::bigint) as c from documents), h as (select doc_id, list_reduce(list_concat([0::bigint], c), lambda h, x: (h * 31 + x) % 4294967296) as h from c) select doc_id, lower(to_hex(abs(case when h >= 2147483648 then h - 4294967296 else h end))) as hash from h")
def rolling_hash(spark, d):
    return t(spark, d, "documents").select("doc_id", strings.rolling_hash(F.col("text")).alias("hash"))


@query("text_edits", """select c_custkey as id, case when contains(c_name, '00') then c_name else c_name || chr(10) || '00' end as added, replace(c_name, '0', 'o') as replaced, regexp_replace(c_name, '0', 'o') as first, regexp_extract_all(c_name, '.{1,4}') as chunks from customer""")
def text_edits(spark, d):
    n = F.col("c_name")
    return t(spark, d, "customer").select(F.col("c_custkey").alias("id"), strings.add_line(n, "00").alias("added"), strings.replace_text(n, "0", "o").alias("replaced"), strings.replace_text(n, "0", "o", "first").alias("first"), strings.chunks(n, 4).alias("chunks"))


@query("html_text", r"""with b as (select page_id, regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', chr(10), 'gis'), '<[^>]*>', chr(10), 'gs') as x from pages),
e as (select page_id, replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') as x from b)
select page_id, array_to_string(list_filter(list_transform(string_split(x, chr(10)), lambda s: trim(s)), lambda s: s <> ''), chr(10)) as text from e""")
def html_text(spark, d):
    return t(spark, d, "pages").select("page_id", strings.strip_html(F.col("html")).alias("text"))


@query("html_links", """select page_id, list_sort(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1))) as links from pages""")
def html_links(spark, d):
    return t(spark, d, "pages").select("page_id", F.sort_array(strings.links(F.col("html"))).alias("links"))


@query("pack_lines", """with recursive l as (select doc_id, list_transform(string_split(text, chr(10)), lambda x: length(x)) as n, string_split(text, chr(10)) as lines from documents where text is not null),
p as (select doc_id, 1 as i, n[1] as size, 1 as chunk from l union all select p.doc_id, p.i + 1, case when p.size + 1 + l.n[p.i + 1] <= 400 then p.size + 1 + l.n[p.i + 1] else l.n[p.i + 1] end, case when p.size + 1 + l.n[p.i + 1] <= 400 then p.chunk else p.chunk + 1 end from p join l using (doc_id) where p.i < len(l.n))
select doc_id, string_agg(l.lines[p.i], chr(10) order by p.i) as chunk from p join l using (doc_id) group by doc_id, p.chunk""")
def pack_lines(spark, d):
    return t(spark, d, "documents").select("doc_id", F.explode(strings.pack_lines(F.col("text"), 400)).alias("chunk"))


@query("cell_names", "select i as id, case when i <= 26 then chr((64 + i)::int) when i <= 702 then chr((65 + (i - 27) // 26)::int) || chr((65 + (i - 27) % 26)::int) else chr((65 + (i - 703) // 676)::int) || chr((65 + (i - 703) // 26 % 26)::int) || chr((65 + (i - 703) % 26)::int) end || '7' as cell, [i, 7]::int[] as back from range(1, 2000) as t(i)")
def cell_names(spark, d):
    cell = strings.cell_name(F.col("id"), F.lit(7))
    return spark.range(1, 2000).select("id", cell.alias("cell"), arrays.from_cell(cell).alias("back"))


# The historic calendar
LEAP = "(y in (-45, -42, -39, -36, -33, -30, -27, -24, -21, -18, -15, -12, -9) or (y % 4 = 0 and y % 100 <> 0) or y % 400 = 0)"


@query("leap_years", f"select y::bigint as year, {LEAP} as leap from range(-10000, 3000) as t(y)")
def leap_years(spark, d):
    return spark.range(-10000, 3000).select(F.col("id").alias("year"), dates.is_leap(F.col("id")).alias("leap"))


@query("year_starts", f"with l as (select y, case when {LEAP} then 366 else 365 end as days from range(-10000, 3000) as t(y)) select y::bigint as year, (case when y >= 0 then coalesce(sum(case when y >= 0 then days end) over (order by y rows between unbounded preceding and 1 preceding), 0) else -sum(case when y < 0 then days end) over (order by y rows between current row and unbounded following) end * 1440)::bigint as minutes from l")
def year_starts(spark, d):
    return spark.range(-10000, 3000).select(F.col("id").alias("year"), dates.timestamp(F.col("id"), F.lit(1), F.lit(1)).alias("minutes"))


@query("date_roundtrip", "select y::int as year, 1 + (abs(y) * 7 % 12)::int as month, 1 + (abs(y) * 5 % 28)::int as day, (abs(y) % 24)::int as hour, (abs(y) * 3 % 60)::int as minute from range(-3000, 2500) as t(y)")
def date_roundtrip(spark, d):
    y, n = F.col("id"), F.abs("id")
    ts = dates.timestamp(y, 1 + n * 7 % 12, 1 + n * 5 % 28, n % 24, n * 3 % 60)
    return spark.range(-3000, 2500).select(dates.to_date(ts).alias("d")).select("d.*")


@query("order_dates", "select o_orderkey, (datediff('day', date '0001-01-01', o_orderdate::date) + 366)::bigint * 1440 as minutes, strftime(o_orderdate, '%Y.%m.%d') as key, month(o_orderdate)::int as month from orders")
def order_dates(spark, d):
    o = F.col("o_orderdate")
    ts = dates.timestamp(F.year(o), F.month(o), F.dayofmonth(o))
    return t(spark, d, "orders").select("o_orderkey", ts.alias("minutes"), strings.day_key(o).alias("key"), dates.month_of(F.date_format(o, "MMMM")).alias("month"))


@query("geo_polygons", "select p_partkey as id, [round((p_partkey % 50) + (p_size % 5 + 1) / 2.0, 6), round((p_partkey * 7) % 50 + (p_size % 3 + 1) / 2.0, 6)] as centroid, ((p_size % 5 + 1) * (p_size % 3 + 1))::double as area, p_partkey % 50 < 10.5 and 10.5 < p_partkey % 50 + p_size % 5 + 1 and (p_partkey * 7) % 50 < 20.5 and 20.5 < (p_partkey * 7) % 50 + p_size % 3 + 1 as hit from part")
def geo_polygons(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    ring = geo.rectangle(k % 50, k * 7 % 50, s % 5 + 1, s % 3 + 1)
    return t(spark, d, "part").select(k.alias("id"), ring.alias("ring")).select("id", rounded(geo.centroid(F.col("ring"))).alias("centroid"), geo.signed_area(F.col("ring")).alias("area"), geo.contains(F.col("ring"), F.lit(10.5), F.lit(20.5)).alias("hit"))


@query("equations", "select p_partkey as id, round(p_size * 2 + sqrt(p_retailprice), 6) as a, round((p_size * 2 + sqrt(p_retailprice)) / 4 - p_size % 7, 6) as b, p_size / 0.0 as c from part where p_size > 0")
def equations(spark, d):
    p = t(spark, d, "part").where("p_size > 0")
    made = compile_assignments("a = size * 2 + Math.sqrt(price); b = a / 4 - size % 7", {"size": F.col("p_size").cast("double"), "price": F.col("p_retailprice")})
    return p.select(F.col("p_partkey").alias("id"), r6(made["a"]).alias("a"), r6(made["b"]).alias("b"), compile_expression("x / 0", {"x": F.col("p_size").cast("double")}).alias("c"))


@query("small_matrices", "select p_partkey as id, [[1.0, p_size + 2.0], [p_size + 1.0, 4.0]] as total, [[1.0, p_size], [2.0, 4.0]] as turned, [[1.0 + p_size * p_size, 2.0 + 4 * p_size], [p_size + 4.0 * p_size, 2.0 * p_size + 16]] as product from part where p_partkey < 0 union all select p_partkey, [[2.0, p_size + 2.0], [p_size + 2.0, 8.0]], [[1.0, p_size], [2.0, 4.0]], [[1.0 + 2 * p_size, 10.0], [p_size + 4.0 * p_size, 2.0 * p_size + 16]] from part")
def small_matrices(spark, d):
    s = F.col("p_size").cast("double")
    m = F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(s, F.lit(4.0)))
    turned = arrays.matrix_transpose(m)
    return t(spark, d, "part").select(F.col("p_partkey").alias("id"), arrays.matrix_add(m, turned).alias("total"), turned.alias("turned"), arrays.matrix_multiply(m, m).alias("product"))
