"""Files: listings, delimited and JSON text, HTML tables, pages and their links, project saves."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings


def listing(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """path, length, modified, age_seconds of all files below a folder; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
    return files.withColumn("age_seconds", F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("modified"))


def base64_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.base64("content").alias("base64"))


def lines_backwards(spark: SparkSession, path: str) -> DataFrame:
    """line_no and line, the last line first."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("line_no", "line")).orderBy(F.desc("line_no"))


def csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)


def csv_vertical(spark: SparkSession, path: str) -> DataFrame:
    """One row per value of the first column; the other columns as arrays of texts in file order."""
    df = csv(spark, path)
    key, *rest = df.columns
    numbered = df.withColumn("_n", F.monotonically_increasing_id())
    gathered = [F.expr(f"transform(sort_array(collect_list(struct(_n, `{c}`))), s -> s['{c}'])").alias(c) for c in rest]
    return numbered.groupBy(key).agg(*gathered)


def csv_horizontal(spark: SparkSession, path: str) -> DataFrame:
    """One row per column: (col, values)."""
    df = csv(spark, path).withColumn("_n", F.monotonically_increasing_id())
    names = [c for c in df.columns if c != "_n"]
    long = df.unpivot(["_n"], names, "col", "value")
    return long.groupBy("col").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "value"))), lambda s: s["value"]).alias("values"))


def loose_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON with comments, bare names, single quotes."""
    reader = spark.read.options(multiLine=True, allowComments=True, allowUnquotedFieldNames=True, allowSingleQuotes=True, allowNonNumericNumbers=True)
    return (reader.schema(schema) if schema else reader).json(path)


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """feature_id, properties (map), kind, polygons (array of polygons of rings): single polygons as one-element lists."""
    schema = "features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>"
    rows = spark.read.options(multiLine=True).schema(schema).json(path).select(F.posexplode("features").alias("feature_id", "f"))
    one, many = "array<array<array<double>>>", "array<array<array<array<double>>>>"
    kind = F.col("f.geometry.type")
    polygons = F.when(kind == "Polygon", F.array(F.from_json("f.geometry.coordinates", one))).when(kind == "MultiPolygon", F.from_json("f.geometry.coordinates", many))
    return rows.select("feature_id", F.col("f.properties").alias("properties"), kind.alias("kind"), polygons.alias("polygons"))


def project_save(spark: SparkSession, path: str) -> DataFrame:
    """(id, class_name, type, ts, value) of a saved project: a JSON object of entities whose history is JSON text with keyframes by timestamp."""
    return _project(spark.read.text(path, wholetext=True))


def _project(whole: DataFrame) -> DataFrame:
    entity = "struct<id: string, class_name: string, type: string, history: string, value: string>"
    entries = whole.select(F.explode(F.from_json("value", f"map<string, {entity}>")).alias("id", "e"))
    frames = F.from_json(F.get_json_object("e.history", "$.keyframes"), "map<string, struct<value: array<string>>>")
    return entries.select("id", "e.class_name", "e.type", F.explode_outer(frames).alias("ts", "k")).select("id", "class_name", "type", F.col("ts").cast("bigint").alias("ts"), F.transform("k.value", lambda v: F.when(v != "undefined", v)).alias("value"))


def write_project(states: DataFrame, path: str) -> None:
    """A saved project from (id, class_name, type, ts, value): as `project_save` reads it, an entity an object, its keyframes as JSON text.

    One text line an entity inside one object a file: entities are dealt to
    files, so no task holds all of them, and the reader merges the files.
    """
    frame = F.struct("ts", F.concat(F.lit('"'), F.col("ts").cast("string"), F.lit('":'), F.to_json(F.struct(F.transform("value", lambda v: F.coalesce(v, F.lit("undefined"))).alias("value")))).alias("text"))
    frames = F.array_join(F.transform(F.sort_array(F.collect_list(frame)), lambda x: x["text"]), ",")  # one entity's own history
    whole = states.groupBy("id", "class_name", "type").agg(F.concat(F.lit('{"keyframes":{'), frames, F.lit("}}")).alias("history"))
    lines = whole.select(F.to_json(F.create_map("id", F.struct("id", "class_name", "type", "history"))).alias("value"))
    lines.write.mode("overwrite").text(path)


def project_lines(spark: SparkSession, path: str) -> DataFrame:
    """As `project_save`, of the files that `write_project` makes: one JSON object a line."""
    return _project(spark.read.text(path))


def texts_by_tag(pages: DataFrame, key: str, html: str, selectors: list[str]) -> DataFrame:
    """(key, text): the text inside the elements that match any of the selectors (tag, .class, #id or tag.class), in page order, joined by line feeds."""

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame([(k, _Selected.of(text or "", selectors)) for k, text in zip(pdf[key], pdf[html], strict=True)], columns=[key, "text"])

    return pages.select(key, html).mapInPandas(run, f"{key} {pages.schema[key].dataType.simpleString()}, text string")


class _Selected(HTMLParser):
    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, selectors: list[str]):
        super().__init__()
        self.selectors, self.open, self.parts = selectors, [], []

    @classmethod
    def of(cls, text: str, selectors: list[str]) -> str:
        parser = cls(selectors)
        parser.feed(text)
        parser.close()
        return "\n".join("".join(p).strip() for p in parser.parts)

    def _matches(self, tag: str, attrs: dict) -> bool:
        classes = (attrs.get("class") or "").split()
        for s in self.selectors:
            name, _, rest = s.partition(".")
            if s.startswith("#") and attrs.get("id") == s[1:] or s.startswith(".") and rest in classes or name and not s.startswith("#") and tag == name and (not rest or rest in classes):
                return True
        return False

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            return
        hit = self._matches(tag, dict(attrs))
        if hit:
            self.parts.append([])
        self.open.append((tag, len(self.parts) - 1 if hit else None))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        for _, part in self.open:
            if part is not None:
                self.parts[part].append(data)


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__()
        self.rows, self.table, self.row, self.cell, self.linked = [], -1, -1, None, False
        self.col = 0

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.table, self.row = self.table + 1, -1
        elif tag == "tr":
            self.row, self.col = self.row + 1, 0
        elif tag in ("td", "th"):
            self.cell, self.linked = [], False
        elif tag == "a" and self.cell is not None:
            self.linked = True

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.rows.append((self.table, self.row, self.col, "".join(self.cell).strip(), self.linked))
            self.col, self.cell = self.col + 1, None


def html_tables(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, table, row, col, text, linked) of every table cell."""

    def run(frames):
        for pdf in frames:
            rows = []
            for k, text in zip(pdf[key], pdf[html], strict=True):
                parser = _Tables()
                parser.feed(text or "")
                rows += [(k, *r) for r in parser.rows]
            yield pd.DataFrame(rows, columns=[key, "table", "row", "col", "text", "linked"])

    return pages.select(key, html).mapInPandas(run, f"{key} {pages.schema[key].dataType.simpleString()}, table int, row int, col int, text string, linked boolean")


def page_links(pages: DataFrame, key: str, html: str, base: str, allow: list[str] = (), deny: list[str] = ()) -> DataFrame:
    """Distinct absolute links (key, link) of pages, by host; `base` is the column with the page's address."""
    host = F.regexp_extract("link", "^[a-z]+://([^/?#]*)", 1)
    root = F.regexp_extract(F.col(base), "^([A-Za-z]+://[^/?#]*)", 1)
    out = pages.select(key, root.alias("_root"), F.explode(strings.links(F.col(html))).alias("link"))
    out = out.withColumn("link", F.when(F.col("link").startswith("/"), F.concat("_root", "link")).otherwise(F.col("link"))).where(F.col("link").rlike("^[a-z]+://"))
    for hosts, keep in ((allow, True), (deny, False)):
        if hosts:
            out = out.where(host.isin(*hosts) if keep else ~host.isin(*hosts))
    return out.select(key, "link").distinct()


def crawl(pages: DataFrame, start: list[str], depth: int) -> DataFrame:
    """(url, depth): pages reachable from the start addresses over links between landed pages, breadth first."""
    spark = pages.sparkSession
    links = page_links(pages, "url", "html", "url")
    seen = spark.createDataFrame([(u, 0) for u in start], "url string, depth int").join(pages.select("url"), "url", "left_semi")
    for d in range(1, depth + 1):
        front = seen.where(F.col("depth") == d - 1).join(links, "url").select(F.col("link").alias("url")).distinct()
        seen = seen.unionByName(front.join(pages.select("url"), "url", "left_semi").join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(d)))
    return seen


def find_in_files(spark: SparkSession, folder: str, pattern: str, case: bool = True, whole_word: bool = False) -> DataFrame:
    """(file, line_no, line) of matching lines."""
    wanted = ("" if case else "(?i)") + (rf"\b(?:{pattern})\b" if whole_word else pattern)
    texts = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return texts.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line")).where(F.col("line").rlike(wanted))


def replace_in_lines(found: DataFrame, pattern: str, by: str) -> DataFrame:
    return found.withColumn("replaced", F.regexp_replace("line", pattern, by))


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)
