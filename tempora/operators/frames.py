"""Table operators: positional rows, headers, unions, search, pages, set operations, workbooks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..equation import compile_assignments, compile_expression
from ..functions.arrays import number
from ..scratch import cut

ROW = "row_idx"


def with_row_index(df: DataFrame, *order: Column) -> DataFrame:
    """row_idx from 0 in the given order, dense, without sending all rows to one task.

    Rows are range-partitioned by the order, and checkpointed, so that counts and
    rows come from the same partitions; each counts its rows, and the counts (one row a partition) give every partition its first index.
    """
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    first = counts.withColumn("_first", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    return ranged.join(F.broadcast(first.select("_part", F.coalesce("_first", F.lit(0)).alias("_first"))), "_part").withColumn(ROW, F.col("_first") + F.col("_at")).drop("_part", "_at", "_first")


def append(a: DataFrame, b: DataFrame, default=None) -> DataFrame:
    """Rows of both under the union of their columns; what b lacks is `default`, what a lacks null."""
    for c in (c for c in a.columns if c not in b.columns):
        b = b.withColumn(c, F.lit(default).cast(a.schema[c].dataType))
    return a.unionByName(b, allowMissingColumns=True)


def operate(a: DataFrame, b: DataFrame, equation: str, key: str = ROW, default: float = 0.0) -> DataFrame:
    """Row by row over two frames: i$Col names a column of a, x$Col of b; assignments to i$Col give the result's columns.

    An equation without an assignment is applied to every shared column as i and x.
    """
    left, right = a.select(key, *[F.col(c).alias(f"i${c}") for c in a.columns if c != key]), b.select(key, *[F.col(c).alias(f"x${c}") for c in b.columns if c != key])
    both = left.join(right, key, "full")
    name = lambda n: number(F.col(f"`{n}`"), default)
    if "=" in equation.replace("==", ""):
        made = {t.split("$", 1)[-1]: c for t, c in compile_assignments(equation, name).items()}
    else:
        shared = [c for c in a.columns if c != key and c in b.columns]
        made = {c: compile_expression(equation, {"i": name(f"i${c}"), "x": name(f"x${c}")}) for c in shared}
    keep = [F.col(f"`i${c}`").alias(c) for c in a.columns if c not in made and c != key]
    return both.select(key, *keep, *[c.alias(n) for n, c in made.items()])


def merge(a: DataFrame, b: DataFrame, equation: str | None = None, default=None) -> DataFrame:
    return append(operate(a, b, equation) if equation else a, b, default)


def find_column(df: DataFrame, name: str) -> str:
    """A column by name without regard to case: the exact one, else the last that holds it."""
    low = name.lower()
    exact = [c for c in df.columns if c.lower() == low]
    part = [c for c in df.columns if low in c.lower()]
    if not (exact or part):
        raise KeyError(name)
    return (exact or part)[-1]


def select_column(df: DataFrame, name: str) -> DataFrame:
    return df.select(find_column(df, name))


def select_row(df: DataFrame, index: int) -> DataFrame:
    return df.where(F.col(ROW) == index)


def set_column(df: DataFrame, name: str, values: DataFrame) -> DataFrame:
    """Values (row_idx, value) put into a column; rows without one become null."""
    return df.drop(name).join(values.select(ROW, F.col("value").alias(name)), ROW, "left").select(*df.columns, *([] if name in df.columns else [name]))


def set_row(df: DataFrame, row: DataFrame) -> DataFrame:
    return df.join(row.select(ROW), ROW, "left_anti").unionByName(row)


def set_header(df: DataFrame, names: list[str]) -> DataFrame:
    return df.toDF(*names)


def dimensions(df: DataFrame) -> DataFrame:
    """columns, rows (the header counts as a row)."""
    return df.agg((F.count("*") + 1).alias("n_rows")).select(F.lit(len(df.columns)).cast("bigint").alias("n_columns"), "n_rows")


def to_columns(df: DataFrame, key: str = ROW) -> DataFrame:
    """Long form (col, map of row to text)."""
    long = df.unpivot([key], [c for c in df.columns if c != key], "col", "value") if len({t for c, t in df.dtypes if c != key}) == 1 else df.select(key, *[F.col(c).cast("string") for c in df.columns if c != key]).unpivot([key], [c for c in df.columns if c != key], "col", "value")
    return long.groupBy("col").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "value")))).alias("values"))


def from_columns(long: DataFrame, columns: list[str], key: str = ROW) -> DataFrame:
    return long.select("col", F.explode("values").alias(key, "value")).groupBy(key).pivot("col", columns).agg(F.first("value"))


def search(df: DataFrame, text: str, columns: list[str] | None = None) -> DataFrame:
    """Rows with the text, trimmed and without regard to case, in any column."""
    cols = columns or df.columns
    return df.where(reduce(Column.__or__, [F.lower(F.col(c).cast("string")).contains(text.strip().lower()) for c in cols]))


def ranked_search(df: DataFrame, query: str, columns: list[str], product: bool = False) -> DataFrame:
    """Relevance len(query) / len(value) of each column that holds the query, summed or multiplied; best first."""
    hit = lambda c: F.when(F.lower(F.col(c)).contains(query.lower()), F.lit(float(len(query))) / F.length(c)).otherwise(0.0 if not product else 1.0)
    score = reduce((lambda a, b: a * b) if product else (lambda a, b: a + b), map(hit, columns))
    found = reduce(Column.__or__, [F.lower(F.col(c)).contains(query.lower()) for c in columns])
    return df.where(found).withColumn("relevance", score)


def smart_lookup(df: DataFrame, query: str, key: str, columns: list[str]) -> DataFrame:
    """One row: the one with this key, else an equal value, else a value that holds the query; the last of equals."""
    low = query.lower()
    level = F.when(F.lower(F.col(key).cast("string")) == low, 3).when(reduce(Column.__or__, [F.lower(F.col(c)) == low for c in columns]), 2).when(reduce(Column.__or__, [F.lower(F.col(c)).contains(low) for c in columns]), 1)
    return df.withColumn("match", level).where("match is not null").orderBy(F.desc("match"), F.desc(key)).limit(1)


def mixed_order(column: str, descending: bool = False) -> list[Column]:
    """Numbers by value before texts by letter."""
    value, text = F.col(column).try_cast("double"), F.col(column).cast("string")
    return [value.desc_nulls_last(), text.desc()] if descending else [value.asc_nulls_last(), text.asc()]


def sort_mixed(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    return df.orderBy(*mixed_order(column, descending))


def page(df: DataFrame, number_: int, size: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).offset(number_ * size).limit(size)


def indexed_view(df: DataFrame, predicate: Column, projection: list[Column], *order: Column) -> DataFrame:
    """Rows that pass, projected, with a running index from 1 in `order`."""
    out = with_row_index(df.where(predicate).select(*projection), *order)
    return out.select((F.col(ROW) + 1).alias("index"), *[c for c in out.columns if c != ROW])


def without_repeated_values(df: DataFrame, value: str) -> DataFrame:
    """Only rows whose value occurs once."""
    once = df.groupBy(value).agg(F.count("*").alias("_n")).where("_n = 1").select(value)
    return df.join(once, value, "left_semi")


def blank_shared_places(df: DataFrame, lat: str, lng: str, places: int = 4) -> DataFrame:
    """Coordinates that several rows share after rounding become null."""
    key = [F.round(lat, places).alias("_a"), F.round(lng, places).alias("_b")]
    many = df.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").select("_a", "_b", F.lit(True).alias("_many"))
    joined = df.select("*", *key).join(many, ["_a", "_b"], "left")
    return joined.withColumns({c: F.when(F.col("_many").isNull(), F.col(c)) for c in (lat, lng)}).drop("_a", "_b", "_many")


# Workbooks in long form: sheet, row, col, v, t (1 text, 2 number), f (formula)
def to_cells(rows: DataFrame, columns: list[str], sheet: int = 0) -> DataFrame:
    """One row per cell; a text that begins with = is a formula."""
    texts = rows.select(F.col(ROW).alias("row"), *[F.col(c).cast("string").alias(c) for c in columns])
    long = texts.select("row", F.posexplode(F.array(*columns)).alias("col", "v"))
    formula = F.col("v").startswith("=")
    return long.where("v is not null").select(F.lit(sheet).alias("sheet"), "row", "col", F.when(~formula, F.col("v")).alias("v"), F.when(formula, None).when(F.col("v").try_cast("double").isNotNull(), 2).otherwise(1).alias("t"), F.when(formula, F.col("v")).alias("f"))


def cell_range(cells: DataFrame, sheet: int, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    return cells.where((F.col("sheet") == sheet) & F.col("row").between(*rows) & F.col("col").between(*cols))


def set_cell(cells: DataFrame, sheet: int, row: int, col: int, v: str) -> DataFrame:
    here = (F.col("sheet") == sheet) & (F.col("row") == row) & (F.col("col") == col)
    return cells.withColumn("v", F.when(here, F.lit(v)).otherwise(F.col("v")))


def cells_to_rows(cells: DataFrame) -> DataFrame:
    """sheet, row, values (array in column order)."""
    value = F.coalesce("f", "v")
    ordered = F.sort_array(F.collect_list(F.struct("col", value.alias("v"))))
    return cells.groupBy("sheet", "row").agg(F.transform(ordered, lambda s: s["v"]).alias("values"))


def series_of(cells: DataFrame, sheet: int, rows: tuple[int, int], cols: tuple[int, int], by_column: bool = False) -> DataFrame:
    """Chart series of a range: the first cell of each row (or column) is its label, the rest its data."""
    along, across = ("col", "row") if by_column else ("row", "col")
    ordered = F.sort_array(F.collect_list(F.struct(F.col(across).alias("at"), F.col("v"))))
    grouped = cell_range(cells, sheet, rows, cols).groupBy(F.col(along).alias("series")).agg(F.transform(ordered, lambda s: s["v"]).alias("a"))
    return grouped.select("series", F.get("a", F.lit(0)).alias("label"), F.transform(F.slice("a", 2, 1 << 20), lambda v: v.try_cast("double")).alias("data"))
