"""The registry: a query is a function of (spark, sf_dir) and, where SQL can say it, the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c, places: int = 6):
    """Rounded to the places that both engines agree on."""
    return F.round(c, places)


def region_cells(spark: SparkSession, d: str) -> DataFrame:
    """(year, cell, region, v): quantities by ship year, part and the customer's region; written once, since raking reads its cells several times."""
    line = t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", F.year("l_shipdate").alias("year"))
    orders = t(spark, d, "orders").select("o_orderkey", "o_custkey")
    where = t(spark, d, "customer").select("c_custkey", "c_nationkey").join(t(spark, d, "nation").select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").alias("region"))
    joined = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(where, F.col("o_custkey") == F.col("c_custkey"))
    return written(joined.groupBy("year", F.col("l_partkey").alias("cell"), "region").agg(F.sum("l_quantity").alias("v")))


REGION_CELLS = """cells as (
  select year(l_shipdate)::int as year, l_partkey as cell, n_regionkey as region, sum(l_quantity) as v
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2, 3)"""


def grid_cells(spark: SparkSession, d: str) -> DataFrame:
    """(year, x, y, v) on a 64 x 32 grid."""
    line = t(spark, d, "lineitem")
    return line.groupBy(F.year("l_shipdate").alias("year"), (F.col("l_partkey") % 64).cast("int").alias("x"), (F.col("l_suppkey") % 32).cast("int").alias("y")).agg(F.sum("l_quantity").alias("v"))


GRID = "grid as (select year(l_shipdate)::int as year, (l_partkey % 64)::int as x, (l_suppkey % 32)::int as y, sum(l_quantity) as v from lineitem group by 1, 2, 3)"


def nation_series(spark: SparkSession, d: str, gaps: bool = True) -> DataFrame:
    """(n_name, year, v): orders per nation and year; every third year is missing with `gaps`."""
    o = t(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("year"))
    c = t(spark, d, "customer").select("c_custkey", "c_nationkey").join(t(spark, d, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    out = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name", "year").agg(F.count("*").cast("double").alias("v"))
    return out.where("year % 3 <> 0") if gaps else out


def series_sql(gaps: bool = True) -> str:
    return "series as (select n_name, year(o_orderdate)::int as year, count(*)::double as v from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey" + (" where year(o_orderdate) % 3 <> 0" if gaps else "") + " group by 1, 2)"
