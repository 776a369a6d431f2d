"""Raster files as rows of cells: ASCII grids, classic NetCDF, GeoTIFF, numbers in PNG pixels, KMZ layers.

Files are read whole by the task that owns them (binaryFile), parsed to arrays
and emitted as cells (file, layer, row, col, v); nodata is null. Readers take a
path or a table of files (file, content), as the writers make it.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "file string, layer int, row int, col int, v double"


def _files(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    if isinstance(path, DataFrame):
        return path.select("file", "content")
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")


def _cells(spark: SparkSession, path: str | DataFrame, parse) -> DataFrame:
    def run(frames):
        for pdf in frames:
            for file, content in zip(pdf["file"], pdf["content"], strict=True):
                for layer, grid in enumerate(parse(bytes(content))):
                    rows, cols = np.indices(grid.shape)
                    for at in range(0, grid.size, 1 << 18):
                        part = slice(at, at + (1 << 18))
                        yield pd.DataFrame({"file": file, "layer": layer, "row": rows.ravel()[part].astype("int32"), "col": cols.ravel()[part].astype("int32"), "v": grid.ravel()[part]})

    return _files(spark, path).mapInPandas(run, CELLS).withColumn("v", F.when(~F.isnan("v"), F.col("v")))


def parse_asc(content: bytes) -> list[np.ndarray]:
    """The grid of an ASCII grid file, header lines by key in any order, nodata as NaN."""
    head, lines = {}, content.decode().splitlines()
    at = 0
    while at < len(lines) and lines[at].split() and lines[at].split()[0][0].isalpha():
        key, value = lines[at].split()[:2]
        head[key.lower()] = float(value)
        at += 1
    grid = np.array(" ".join(lines[at:]).split(), float).reshape(int(head["nrows"]), int(head["ncols"]))
    return [np.where(grid == head.get("nodata_value", np.nan), np.nan, grid)]


def read_asc(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    return _cells(spark, path, parse_asc)


def grids_as_files(cells: DataFrame, width: int, height: int, encode, name: str = "year") -> DataFrame:
    """(file, content): one file's bytes for each value of the layer column `name`, which is the file's name; cells have row, col and v.

    `encode` makes the bytes of a (height, width) array, missing cells as NaN. A
    task holds one grid at a time.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.full((height, width), np.nan)
        grid[pdf["row"], pdf["col"]] = pdf["v"]
        return pd.DataFrame({"file": [str(pdf[name].iloc[0])], "content": [encode(grid)]})

    return cells.select(name, "row", "col", "v").groupBy(name).applyInPandas(run, "file string, content binary")


def asc_text(grid: np.ndarray, cell: float = 1.0, nodata: float = -9999) -> str:
    rows = "\n".join(" ".join(f"{nodata if np.isnan(v) else v:g}" for v in r) for r in grid)
    return f"ncols {grid.shape[1]}\nnrows {grid.shape[0]}\nxllcorner -180\nyllcorner -90\ncellsize {cell:g}\nNODATA_value {nodata:g}\n{rows}\n"


_NC = {1: (">i1", 1), 2: ("S1", 1), 3: (">i2", 2), 4: (">i4", 4), 5: (">f4", 4), 6: (">f8", 8)}


def parse_netcdf(content: bytes) -> dict[str, tuple[list[str], np.ndarray]]:
    """{variable: (dimension names, array)} of a classic NetCDF file."""
    f = io.BytesIO(content)
    if f.read(3) != b"CDF":
        raise ValueError("not a classic NetCDF file")
    wide = f.read(1) == b"\x02"
    number = lambda: struct.unpack(">i", f.read(4))[0]

    def name() -> str:
        n = number()
        text = f.read(n).decode()
        f.read(-n % 4)
        return text

    def attributes() -> dict:
        out = {}
        number()
        for _ in range(number()):
            key, kind, n = name(), *(number() for _ in range(2))
            dtype, size = _NC[kind]
            raw = f.read(n * size)
            f.read(-n * size % 4)
            out[key] = raw.decode(errors="replace") if kind == 2 else np.frombuffer(raw, dtype)
        return out

    records = number()
    number()
    dims = [(name(), number()) for _ in range(number())]
    attributes()
    number()
    variables = []
    for _ in range(number()):
        label = name()
        ids = [number() for _ in range(number())]
        attrs, kind, size = attributes(), number(), number()
        begin = struct.unpack(">q", f.read(8))[0] if wide else number()
        variables.append((label, ids, attrs, kind, size, begin))
    is_record = lambda ids: bool(ids) and dims[ids[0]][1] == 0
    stride = sum(v[4] for v in variables if is_record(v[1]))
    out = {}
    for label, ids, attrs, kind, _size, begin in variables:
        dtype, item = _NC[kind]
        shape = [dims[i][1] for i in ids]
        if is_record(ids):
            each = int(np.prod(shape[1:], dtype=int)) * item
            raw = b"".join(content[begin + r * stride : begin + r * stride + each] for r in range(records))
            shape[0] = records
        else:
            raw = content[begin : begin + int(np.prod(shape, dtype=int)) * item]
        data = np.frombuffer(raw, dtype).reshape(shape)
        if kind != 2:
            data = data.astype(float)
            for key in ("_FillValue", "missing_value"):
                if key in attrs:
                    data = np.where(data == float(attrs[key][0]), np.nan, data)
        out[label] = ([dims[i][0] for i in ids], data)
    return out


def netcdf_bytes(variable: str, values: np.ndarray) -> bytes:
    """A classic NetCDF file of one double variable over (time, lat, lon)."""
    label = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    dims = b"".join(label(n) + struct.pack(">i", size) for n, size in zip(("time", "lat", "lon"), values.shape, strict=True))
    head = b"CDF\x01" + struct.pack(">iii", 0, 10, 3) + dims + struct.pack(">iiii", 0, 0, 11, 1)
    about = label(variable) + struct.pack(">iiiiii", 3, 0, 1, 2, 0, 0) + struct.pack(">ii", 6, values.nbytes)
    return head + about + struct.pack(">i", len(head) + len(about) + 4) + values.astype(">f8").tobytes()


def netcdf_variables(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(file, variable, dims, shape)."""

    def run(frames):
        for pdf in frames:
            rows = [(file, v, d, list(a.shape)) for file, c in zip(pdf["file"], pdf["content"], strict=True) for v, (d, a) in parse_netcdf(bytes(c)).items()]
            yield pd.DataFrame(rows, columns=["file", "variable", "dims", "shape"])

    return _files(spark, path).mapInPandas(run, "file string, variable string, dims array<string>, shape array<int>")


def read_netcdf(spark: SparkSession, path: str | DataFrame, variable: str) -> DataFrame:
    """Cells of one variable; its leading dimension (time) is the layer."""

    def parse(content: bytes) -> list[np.ndarray]:
        data = parse_netcdf(content)[variable][1]
        return list(data) if data.ndim == 3 else [np.atleast_2d(data)]

    return _cells(spark, path, parse)


def parse_png(content: bytes) -> np.ndarray:
    """Pixels (rows, columns, channels) of a non-interlaced 8-bit PNG."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, data, palette = 8, b"", None
    while at < len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if depth != 8 or interlace:
                raise ValueError("only 8-bit non-interlaced PNG files are read")
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.uint8)
    above = np.zeros(width * channels, np.uint8)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:]
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = line + above
        elif kind == 1:
            out[y] = np.cumsum(line.reshape(width, channels), axis=0, dtype=np.uint8).ravel()
        else:
            cur = out[y]
            for i in range(width * channels):
                left = int(cur[i - channels]) if i >= channels else 0
                up, corner = int(above[i]), int(above[i - channels]) if i >= channels else 0
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((left, up, corner), key=lambda v: abs(p - v))
                cur[i] = (int(line[i]) + guess) & 255
        above = out[y]
    pixels = out.reshape(height, width, channels)
    return palette[pixels[:, :, 0]] if colour == 3 else pixels


def png_bytes(pixels: np.ndarray) -> bytes:
    """A PNG file of (rows, columns, 1, 3 or 4) bytes."""
    height, width, channels = pixels.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    body = b"".join(b"\x00" + pixels[y].tobytes() for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def encode_numbers(grid: np.ndarray) -> np.ndarray:
    """ceil of each number as four bytes, the highest first; null as 0."""
    n = np.ceil(np.nan_to_num(grid)).astype(np.uint64)
    return np.stack([(n >> np.uint64(s)) & np.uint64(255) for s in (24, 16, 8, 0)], axis=-1).astype(np.uint8)


def decode_numbers(pixels: np.ndarray) -> np.ndarray:
    p = pixels.astype(float)
    return p[:, :, 0] * 16777216 + p[:, :, 1] * 65536 + p[:, :, 2] * 256 + (p[:, :, 3] if p.shape[2] > 3 else 255)


def read_png(spark: SparkSession, path: str | DataFrame, mode: str = "number") -> DataFrame:
    """Cells of PNG rasters: `number` (32 bits a pixel) or `grey` (0 … 1)."""

    def parse(content: bytes) -> list[np.ndarray]:
        pixels = parse_png(content)
        return [decode_numbers(pixels) if mode == "number" else pixels[:, :, 0] / 255.0]

    return _cells(spark, path, parse)


def write_png(cells: DataFrame, width: int, height: int, folder: str) -> DataFrame:
    """(year, png): one file's bytes per year from cells (year, row, col, v), as rows, so any sink can store them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((height, width))
        grid[pdf["row"], pdf["col"]] = pdf["v"].fillna(0)
        return pd.DataFrame({"year": [int(pdf["year"].iloc[0])], "png": [png_bytes(encode_numbers(grid))]})

    out = cells.select("year", "row", "col", "v").groupBy("year").applyInPandas(run, "year int, png binary")
    out.write.mode("overwrite").parquet(folder)
    return out.sparkSession.read.parquet(folder)


def read_kmz(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(file, kind, coordinates, name, description) of the placemarks of KMZ or KML files."""

    def run(frames):
        for pdf in frames:
            rows = []
            for file, content in zip(pdf["file"], pdf["content"], strict=True):
                data = bytes(content)
                if data[:2] == b"PK":
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        data = z.read(next(n for n in z.namelist() if n.endswith(".kml")))
                for mark in ElementTree.fromstring(data).iter():
                    if mark.tag.rpartition("}")[2] == "Placemark":
                        text = {e.tag.rpartition("}")[2]: (e.text or "").strip() for e in mark.iter()}
                        kind = next((k for k in ("Polygon", "LineString", "Point") if k in text), None)
                        points = [[float(v) for v in p.split(",")[:2]] for p in text.get("coordinates", "").split()]
                        rows.append((file, kind, points, text.get("name"), text.get("description")))
            yield pd.DataFrame(rows, columns=["file", "kind", "coordinates", "name", "description"])

    return _files(spark, path).mapInPandas(run, "file string, kind string, coordinates array<array<double>>, name string, description string")


def kml_text(marks: list[tuple[str, str, list]]) -> str:
    """A KML document of (kind, name, points) placemarks."""
    one = lambda kind, points: f"<{kind}><coordinates>{' '.join(f'{x},{y},0' for x, y in points)}</coordinates></{kind}>"
    shape = lambda kind, points: f"<Polygon><outerBoundaryIs>{one('LinearRing', points)}</outerBoundaryIs></Polygon>" if kind == "Polygon" else one(kind, points)
    body = "".join(f"<Placemark><name>{escape(name)}</name>{shape(kind, points)}</Placemark>" for kind, name, points in marks)
    return f'<kml xmlns="http://www.opengis.net/kml/2.2"><Document>{body}</Document></kml>'


def kmz_bytes(marks: list[tuple[str, str, list]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("doc.kml", kml_text(marks))
    return out.getvalue()


_TIFF_SIZES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}


def _unpack_lzw(data: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, highest bit first; 256 clears the table, 257 ends."""
    out, table, width, held, bits, last = bytearray(), [], 9, 0, 0, None
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last is not None:
            table.append(last + entry[:1])
        last = entry
        width = max(9, min(12, (len(table) + 1).bit_length()))
    return bytes(out)


def parse_tiff(content: bytes) -> list[np.ndarray]:
    """The bands of a TIFF raster: strips or tiles, chunky or planar, plain, LZW or deflate, whole numbers or floats; nodata as NaN."""
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if order is None or struct.unpack(order + "H", content[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack(order + "I", content[4:8])[0]
    tags = {}
    for i in range(struct.unpack(order + "H", content[at : at + 2])[0]):
        tag, kind, n = struct.unpack(order + "HHI", content[at + 2 + 12 * i : at + 10 + 12 * i])
        if kind not in _TIFF_SIZES:
            continue
        code, size = _TIFF_SIZES[kind]
        start = at + 10 + 12 * i
        if n * size > 4:
            start = struct.unpack(order + "I", content[start : start + 4])[0]
        raw = content[start : start + n * size]
        tags[tag] = raw.rstrip(b"\0").decode() if kind == 2 else struct.unpack(f"{order}{n * len(code)}{code[0]}", raw)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, bands, planar, packed, predictor = tags[256][0], tags[257][0], one(277, 1), one(284, 1) == 2, one(259, 1), one(317, 1)
    dtype = np.dtype(order + {1: "u", 2: "i", 3: "f"}[one(339, 1)] + str(one(258, 1) // 8))
    tiled = 324 in tags
    wide, high = (tags[322][0], tags[323][0]) if tiled else (width, min(one(278, height), height))
    across, down = -(-width // wide), -(-height // high)
    each = 1 if planar else bands
    grid = np.zeros((bands, down * high, across * wide))
    for i, (start, size) in enumerate(zip(tags[324 if tiled else 273], tags[325 if tiled else 279], strict=True)):
        raw = content[start : start + size]
        if packed == 5:
            raw = _unpack_lzw(raw)
        elif packed in (8, 32946):
            raw = zlib.decompress(raw)
        elif packed != 1:
            raise ValueError(f"TIFF compression {packed} is not read")
        band, place = divmod(i, across * down) if planar else (0, i)
        y, x = place // across * high, place % across * wide
        rows = len(raw) // (wide * each * dtype.itemsize)
        block = np.frombuffer(raw, dtype, rows * wide * each).reshape(rows, wide, each)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=dtype)
        elif predictor != 1:
            raise ValueError(f"TIFF predictor {predictor} is not read")
        grid[band : band + each, y : y + rows, x : x + wide] = np.moveaxis(block, 2, 0)
    grid = grid[:, :height, :width]
    nodata = str(tags.get(42113, "")).strip()
    return [np.where(b == float(nodata), np.nan, b) if nodata else b for b in grid]


def read_tiff(spark: SparkSession, path: str | DataFrame, scale: float = 1.0) -> DataFrame:
    """Cells of all bands, the band as layer, values times `scale`."""
    return _cells(spark, path, lambda content: [b * scale for b in parse_tiff(content)])


def tiff_bytes(bands: np.ndarray, nodata: float = -9999.0, compress: bool = True) -> bytes:
    """A little-endian TIFF of (bands, height, width) doubles, planar, one strip a band, NaN as nodata."""
    n, height, width = bands.shape
    strips = [np.where(np.isnan(b), nodata, b).astype("<f8").tobytes() for b in bands]
    strips = [zlib.compress(s) for s in strips] if compress else strips
    text = f"{nodata:g}".encode() + b"\0"
    tags = [(256, 4, [width]), (257, 4, [height]), (258, 3, [64] * n), (259, 3, [8 if compress else 1]), (262, 3, [1]), (273, 4, [0] * n), (277, 3, [n]), (278, 4, [height]), (279, 4, list(map(len, strips))), (284, 3, [2]), (339, 3, [3] * n), (42113, 2, text)]
    spare = 8 + 2 + 12 * len(tags) + 4
    starts = spare + sum(len(v) * _TIFF_SIZES[k][1] for _, k, v in tags if len(v) * _TIFF_SIZES[k][1] > 4)
    tags[5] = (273, 4, [starts + sum(map(len, strips[:i])) for i in range(n)])
    entries, beyond = b"", b""
    for tag, kind, values in tags:
        code, size = _TIFF_SIZES[kind]
        raw = values if kind == 2 else struct.pack(f"<{len(values)}{code}", *values)
        entries += struct.pack("<HHI", tag, kind, len(values)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", spare + len(beyond)))
        beyond += raw if len(raw) > 4 else b""
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + beyond + b"".join(strips)


def mask_years(files: DataFrame, path: str = "path") -> DataFrame:
    """start and end year of files named <name>_<start>_<end>.png; others left out."""
    at = lambda i: F.regexp_extract(path, r"_(-?\d+)_(-?\d+)\.png$", i).try_cast("int")
    return files.withColumns({"start": at(1), "end": at(2)}).where("start is not null")
