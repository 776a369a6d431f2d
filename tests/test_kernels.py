"""Kernels and sources without SQL: hand-made expectations and round trips."""

from __future__ import annotations

import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.equation import compile_expression
from tempora.functions import dates, geo, maths, strings
from tempora.operators import entities, graph, linalg, raster, series, vector
from tempora.sources import files, rasters
from tempora.streaming import ontology


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text,value", [("1 + 2 * 3", 7), ("2 ** 3 ** 2", 512), ("-2 ** 2", -4), ("(1 + 2) * 3", 9), ("7 % 4 - 1", 2), ("max(1, 2) / 4", 0.5), ("1 / 0", float("inf")), ("-5 % 3", -2)])
def test_equation(spark, text, value):
    assert one(spark, compile_expression(text, {})) == pytest.approx(value)


@pytest.mark.parametrize("text", ["1 +", "foo", "eval(1)", "1 2", "a $ 3 ("])
def test_equation_rejects(spark, text):
    with pytest.raises(ValueError):
        compile_expression(text, {"a": F.lit(1)})


def test_spline_runs_through_its_knots():
    x, y = np.array([0.0, 1, 3, 4, 7]), np.array([1.0, 4, 2, 5, 3])
    assert np.allclose(series.natural_spline(x, y, x), y)
    line = np.arange(5.0)
    assert np.allclose(series.natural_spline(line, 3 * line + 1, np.array([0.5, 2.25])), [2.5, 7.75])
    out = series.log_spline(np.array([1900, 1910, 1920]), np.array([10.0, 1000.0, 20.0]), np.arange(1900, 1921))
    assert out.max() <= 1000 and out.min() >= 10 and out[10] == pytest.approx(1000)


def test_polygon_kernels():
    square = [[0, 0], [10, 0], [10, 10], [0, 10]]
    assert vector.area(square) == 100
    assert vector.area(vector.clip(square, [[5, 5], [15, 5], [15, 15], [5, 15]])) == pytest.approx(25)
    assert vector.clip(square, [[20, 20], [30, 20], [30, 30], [20, 30]]) == []
    assert vector.simplify([[0, 0], [1, 0.01], [2, 0], [2, 2]], 0.1) == [[0, 0], [2, 0], [2, 2]]
    assert np.allclose(vector.pole([square], 0.01), [5, 5], atol=0.1)
    shape = [[0, 0], [20, 0], [20, 4], [8, 4], [8, 8], [0, 8]]
    x, y = vector.pole([shape], 0.01)
    assert vector.inside(shape, x, y)
    assert len(vector.fill(square, 100, 100)) == 100
    assert vector.fill([[3.1, 3.1], [3.2, 3.1], [3.2, 3.2]], 10, 10) == [(3, 3)]


def test_polygonise_holes_and_corners(spark):
    ring = [(x, y, "a") for x in range(3) for y in range(3) if (x, y) != (1, 1)] + [(5, 5, "b"), (6, 6, "b")]
    out = raster.polygonise(spark.createDataFrame(ring, "x int, y int, colour string")).collect()
    areas = {c: sorted(vector.area([list(p) for p in r["ring"]]) for r in out if r["colour"] == c) for c in "ab"}
    assert areas["a"] == [-1, 9] and sum(areas["b"]) == 2


def test_rake_conserves_totals(spark):
    cells = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 0.0), ("c", 5.0)], "zone string, v double")
    targets = spark.createDataFrame([("a", 100.0), ("b", 50.0)], "zone string, target double")
    out = {(r["zone"], r["v"]) for r in raster.rake(cells, ["zone"], targets).collect()}
    assert out == {("a", 25.0), ("a", 75.0), ("b", 0.0), ("c", 5.0)}


def test_dense_algebra():
    a = np.array([[4.0, 1, 2], [1, 3, 0], [2, 0, 5]])
    low, up = linalg.lu(a)
    assert np.allclose(low @ up, a)
    c = linalg.cholesky(a)
    assert np.allclose(c @ c.T, a)
    q, r = linalg.qr(a)
    assert np.allclose(q @ r, a) and np.allclose(q.T @ q, np.eye(3))
    t = linalg.tridiagonal(a)
    assert abs(t[0, 2]) < 1e-9 and np.allclose(np.linalg.eigvalsh(t), np.linalg.eigvalsh(a))
    b = np.array([1.0, 2, 3])
    for x in (linalg.solve(np.c_[a, b]), linalg.relax(a, b), linalg.relax(a, b, "seidel", 1.1, 1e-10), linalg.least_squares(a, b)):
        assert np.allclose(a @ x, b, atol=1e-4)


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("a", "c", 5.0), ("d", "e", 1.0)], "src string, dst string, cost double")
    best = graph.shortest_paths(edges, "a")
    assert {r["node"]: r["cost"] for r in best.collect()} == {"a": 0.0, "b": 1.0, "c": 3.0}
    assert graph.path_to(best, "c") == ["a", "b", "c"] and graph.path_to(best, "e") == []
    assert graph.layers([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")]) == [["a"], ["b", "c"], ["d"]]
    assert graph.layers([("a", "b"), ("b", "a")]) is None


def test_dates(spark):
    assert one(spark, dates.describe(dates.to_date(dates.timestamp(F.lit(1900), F.lit(1), F.lit(1))))) == "1st January 1900AD - 00:00"
    assert one(spark, dates.to_date(F.lit(-1)))["year"] == -1
    assert one(spark, dates.timestamp(F.lit(0), F.lit(13), F.lit(1), F.lit(0), F.lit(1500))) == one(spark, dates.timestamp(F.lit(1), F.lit(1), F.lit(2), F.lit(1), F.lit(0)))
    assert one(spark, dates.parse(F.lit("-45.3.2")))["month"] == 3
    assert one(spark, dates.parse(F.lit("x.3"))) is None
    assert one(spark, dates.strip_key(F.lit("t_bcd"))) == 123


def test_texts(spark):
    assert one(spark, strings.european_number(F.lit("1.234,5 x"))) == 1234.5
    assert one(spark, strings.replace_text(F.lit("aXbXc"), "X", "-", "last")) == "aXb-c"
    assert one(spark, strings.replace_text(F.lit("aXbXc"), "X", "-", "first")) == "a-bXc"
    assert one(spark, strings.duration(F.lit(90061))) == "1d 1h 1m 1s"
    assert one(spark, strings.localise(F.lit("hi"), {"hi": "Hello {0}"}, F.lit("you"))) == "Hello you"
    assert one(spark, maths.german(F.lit(1234567.5), 1)) == "1.234.567,5"
    assert one(spark, strings.pack_lines(F.lit("aa\nbb\ncccccccc"), 5)) == ["aa\nbb", "cccccccc"]


def test_geometry_columns(spark):
    ring = geo.rectangle(F.lit(1), F.lit(2), F.lit(3), F.lit(4))
    assert tuple(one(spark, geo.bounds(ring))) == (1, 2, 4, 6) and one(spark, geo.centre(ring)) == [2.5, 4.0]
    assert one(spark, geo.shape_key(ring)) == one(spark, geo.shape_key(geo.truncated(ring)))
    assert one(spark, geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) == pytest.approx(20015.09, abs=0.1)
    moved = one(spark, geo.offset(F.lit(0.0), F.lit(0.0), F.lit(111194.9), F.lit(0.0)))
    assert moved == pytest.approx([0, 1], abs=1e-4)
    whole = geo.rectangle(F.lit(0), F.lit(0), F.lit(1), F.lit(1))
    assert one(spark, geo.geodesic_area(whole)) == pytest.approx(1.2364e10, rel=1e-3)


def test_raster_files(spark, tmp_path):
    grid = np.array([[1, 2, np.nan], [0, 256.0, 1.2]])
    (tmp_path / "g.asc").write_text(rasters.asc_text(grid))
    cells = {(r["row"], r["col"]): r["v"] for r in rasters.read_asc(spark, str(tmp_path / "g.asc")).collect()}
    assert cells[0, 2] is None and cells[1, 1] == 256 and len(cells) == 6
    numbers = np.array([[0, 1, 255], [256, 65536, 2**32 - 1]], float)
    (tmp_path / "n.png").write_bytes(rasters.png_bytes(rasters.encode_numbers(numbers)))
    back = {(r["row"], r["col"]): r["v"] for r in rasters.read_png(spark, str(tmp_path / "n.png")).collect()}
    assert all(back[i, j] == numbers[i, j] for i in range(2) for j in range(3))
    long = spark.createDataFrame([(1900, 0, 1, 7.5)], "year int, row int, col int, v double")
    png = rasters.write_png(long, 2, 1, str(tmp_path / "out")).first()["png"]
    assert rasters.decode_numbers(rasters.parse_png(bytes(png))).tolist() == [[0, 8]]


def netcdf(values: np.ndarray) -> bytes:
    name = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    dims = b"".join(name(n) + struct.pack(">i", s) for n, s in zip(("time", "lat", "lon"), values.shape, strict=True))
    head = b"CDF\x01" + struct.pack(">i", 0) + struct.pack(">ii", 10, 3) + dims + struct.pack(">ii", 0, 0) + struct.pack(">ii", 11, 1)
    var = name("pop") + struct.pack(">iiii", 3, 0, 1, 2) + struct.pack(">ii", 0, 0) + struct.pack(">ii", 6, values.nbytes)
    begin = len(head) + len(var) + 4
    return head + var + struct.pack(">i", begin) + values.astype(">f8").tobytes()


def test_netcdf(spark, tmp_path):
    values = np.arange(12.0).reshape(2, 2, 3)
    (tmp_path / "a.nc").write_bytes(netcdf(values))
    assert rasters.netcdf_variables(spark, str(tmp_path / "a.nc")).first()["shape"] == [2, 2, 3]
    got = {(r["layer"], r["row"], r["col"]): r["v"] for r in rasters.read_netcdf(spark, str(tmp_path / "a.nc"), "pop").collect()}
    assert got[1, 1, 2] == 11 and len(got) == 12


def test_text_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Entity,Year,Value\nAsia,1800,"1,5"\nAsia,1900,2\nEurope,1800,3\n')
    rows = {r["Entity"]: r["Value"] for r in files.csv_vertical(spark, str(tmp_path / "a.csv")).collect()}
    assert rows == {"Asia": ["1,5", "2"], "Europe": ["3"]}
    assert files.csv_horizontal(spark, str(tmp_path / "a.csv")).where("col = 'Year'").first()["values"] == ["1800", "1900", "1800"]
    assert [r["line"] for r in files.lines_backwards(spark, str(tmp_path / "a.csv")).collect()][0] == "Europe,1800,3"
    (tmp_path / "p.json").write_text('{"e1": {"id": "e1", "class_name": "Polygon", "type": "g", "history": "{\\"keyframes\\": {\\"-5\\": {\\"value\\": [\\"undefined\\", \\"s\\"]}}}"}}')
    save = files.project_save(spark, str(tmp_path / "p.json")).first()
    assert (save["id"], save["ts"], save["value"]) == ("e1", -5, [None, "s"])
    kml = '<kml xmlns="http://www.opengis.net/kml/2.2"><Placemark><name>n</name><Point><coordinates>1,2,0</coordinates></Point></Placemark></kml>'
    with zipfile.ZipFile(tmp_path / "a.kmz", "w") as z:
        z.writestr("doc.kml", kml)
    mark = rasters.read_kmz(spark, str(tmp_path / "a.kmz")).first()
    assert (mark["kind"], mark["coordinates"], mark["name"]) == ("Point", [[1.0, 2.0]], "n")
    pages = spark.createDataFrame([("http://a.b/x", '<table><tr><th>h</th></tr><tr><td><a href="/y">1</a></td></tr></table>'), ("http://a.b/y", "end")], "url string, html string")
    cells = files.html_tables(pages, "url", "html").collect()
    assert [(c["row"], c["text"], c["linked"]) for c in cells] == [(0, "h", False), (1, "1", True)]
    assert {(r["url"], r["depth"]) for r in files.crawl(pages, ["http://a.b/x"], 2).collect()} == {("http://a.b/x", 0), ("http://a.b/y", 1)}
    masks = spark.createDataFrame([("m_-3000_1500.png",), ("bad.png",)], "path string")
    assert [(r["start"], r["end"]) for r in rasters.mask_years(masks).collect()] == [(-3000, 1500)]
    found = files.find_in_files(spark, str(tmp_path / "a.csv"), "asia", case=False, whole_word=True)
    assert [r["line_no"] for r in found.collect()] == [1, 2]
    assert files.replace_in_lines(found, "Asia", "X").first()["replaced"].startswith("X,")


def test_deep_chains_are_walked_to_their_end(spark):
    chain = spark.range(200).select(F.col("id").alias("parent"), (F.col("id") + 1).alias("child"))
    assert graph.closure(chain).count() == 200 * 201 // 2
    start = spark.createDataFrame([(0,)], "id bigint")
    assert graph.below(chain.where("parent < 70"), start).agg(F.max("distance")).first()[0] == 70
    best = graph.shortest_paths(chain.where("parent < 60").select(F.col("parent").alias("src"), F.col("child").alias("dst"), F.lit(1.0).alias("cost")), 0)
    assert best.count() == 61 and best.agg(F.max("cost")).first()[0] == 60
    ring = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "parent bigint, child bigint")
    with pytest.raises(ValueError):
        graph.closure(ring)
    with pytest.raises(ValueError):
        graph.below(ring, start)
    tree = spark.createDataFrame([("r", "a", 1_500_000), ("r", "b", 999_999), ("b", "c", 0)], "parent string, child string, pos bigint")
    assert [r["node"] for r in graph.rendering_order(tree, ["r"]).orderBy("path").collect()] == ["r", "b", "c", "a"]


def test_entity_edits(spark):
    edges = spark.createDataFrame([("r", "a", 0), ("a", "b", 0), ("r", "c", 1)], "parent string, child string, pos bigint")
    things = spark.createDataFrame([(x, False) for x in "rabc"], "id string, hidden boolean")
    assert {r["id"] for r in entities.set_hidden(things, edges, "a", True).where("hidden").collect()} == {"a", "b"}
    left, kept = entities.delete(things, edges, "a")
    assert {r["id"] for r in left.collect()} == {"r", "c"} and [r["child"] for r in kept.collect()] == ["c"]
    actions = spark.createDataFrame([("m", i, "k") for i in range(5)] + [("f", i, "k") for i in range(2)], "timeline string, idx bigint, key string")
    lines = entities.branch(actions, spark.createDataFrame([("m", None, None)], "id string, parent string, parent_idx bigint"), "m", 2, "f")
    assert [(r["timeline"], r["idx"]) for r in entities.lineage(actions, lines, "f").orderBy("step").collect()] == [("m", 0), ("m", 1), ("m", 2), ("f", 0), ("f", 1)]


def test_events_of_one_time_are_merged(spark):
    rows = [("a", 1, "p", {"x": "1"}), ("a", 1, "q", {"y": "2", "x": "3"}), ("a", 2, "p", {"y": None}), ("a", 2, "p", {"y": None}), ("b", 1, None, None)]
    e = spark.createDataFrame(rows, "id string, date bigint, type string, data map<string,string>")
    got = {(r["id"], r["date"]): r["state"] for r in ontology.snapshots(e).collect()}
    assert got == {("a", 1): {"x": "3", "y": "2"}, ("a", 2): {"x": "3"}, ("b", 1): {}}
    assert {r["id"]: r["state"] for r in ontology.states_at(e, F.lit(9)).collect()} == {"a": {"x": "3"}, "b": {}}


def test_boxes_intersect_meets_equal_boxes_once(spark, monkeypatch):
    monkeypatch.setattr(vector, "MEMBERS", 4)
    rows = [(i if i % 10 else None, i % 3 * 5, 0, 7, 2) for i in range(90)]
    boxes = spark.createDataFrame(rows, "shape_id long, x0 int, y0 int, w int, h int")
    out = vector.boxes_intersect(boxes, boxes, 4)
    shared = lambda p, q: max(0, min(p[1] + 7, q[1] + 7) - max(p[1], q[1])) * 2
    want = sorted((p[0] or 0, q[0] or 0, shared(p, q)) for p in rows for q in rows if shared(p, q))
    assert sorted((r[0] or 0, r[1] or 0, r[2]) for r in out.collect()) == want
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "explode(b_ids" in plan  # shapes are listed beside their box, not joined one by one


def test_folding_many_cities_equals_folding_each(monkeypatch):
    import pandas as pd
    import pyarrow as pa

    from tempora.plans import pipelines

    rng, rows = np.random.default_rng(5), []
    for i in range(60):
        for match in [None, *sorted(rng.choice(1000, rng.integers(0, 9), replace=False).tolist())]:
            for year in sorted(rng.choice(30, rng.integers(1, 12), replace=False).tolist()):
                rows.append((i, match, 1800 + year, float(rng.integers(0, 40))))
    rows.append((60, None, 1800, 1.0))
    rows += [(60, 3, 1800, 9.0), (60, 3, 1810, None)]  # a value is missing: folded by itself
    table = pa.table({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate((("id", pa.int64()), ("match", pa.int64()), ("year", pa.int32()), ("v", pa.float64())))})
    want = pd.concat([pipelines._fold(g) for _, g in table.to_pandas().groupby("id")])
    want = sorted(zip(want["id"], want["year"], want["v"], strict=True))
    for size, cells in ((1 << 18, 1 << 22), (50, 64)):
        monkeypatch.setattr(pipelines, "FOLD_ROWS", size)
        monkeypatch.setattr(pipelines, "FOLD_CELLS", cells)
        got = [r for b in pipelines._folded(iter(table.to_batches(max_chunksize=37))) for r in zip(*b.to_pydict().values(), strict=True)]
        assert sorted(got) == want
