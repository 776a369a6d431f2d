"""What the corpus operators share: reading tables, scratch tables that outlive executors."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: White space of the corpus contracts: space and the five ASCII controls from tab to carriage return.
WORD_RE = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = "\x20\x09\x0a\x0b\x0c\x0d"

#: Most words of 64 bits in the filter of `maybe_among`, about 80 bytes each in a broadcast.
FILTER_WORDS = 1 << 17

_own_scratch: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share. Read from the session; one of our own only where it is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_scratch:
        _own_scratch.append("file://" + tempfile.mkdtemp(prefix="tempora-"))
    return _own_scratch[0]


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def staged(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back, which cuts its lineage.

    A lost executor later costs a re-read, not a recomputation, and what a
    non-deterministic row order decided stays decided. The files go when the
    driver ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tempora-{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)

    def clean() -> None:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001 - the session is ending, the folder may be gone
            return

    atexit.register(clean)
    return spark.read.schema(df.schema).parquet(path)


def salted_join(rows: DataFrame, few: DataFrame, key: str | list[str], by: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """`rows` joined with `few` (at most one row a key), where one key may hold a large part of `rows`.

    Each key is split by a hash of `by` into `salts` parts, and `few` is repeated for each.
    The repeated rows are merged, never broadcast: Spark's estimate of their size
    does not count the repeats, so `salts` times its limit would go through the driver.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    repeated = few.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return dealt.join(repeated.hint("merge"), [*([key] if isinstance(key, str) else key), "_salt"], how).drop("_salt")


def maybe_among(rows: DataFrame, ids: DataFrame, n: int, by: str = "doc_id") -> DataFrame:
    """The rows of `rows` whose column `by` is one of the `n` of `ids`, and few others.

    What is broadcast are at most `FILTER_WORDS` words of a Bloom filter (an id
    sets four bits of one word), whatever `n`; more ids let more other rows pass.
    """
    words = min(FILTER_WORDS, n // 4 + 1)
    mask = " | ".join(f"shiftleft(1L, cast(shiftright(_hash, {6 * i}) & 63 as int))" for i in range(4))

    def marked(df: DataFrame) -> DataFrame:
        return df.withColumn("_word", F.pmod(F.xxhash64(by), F.lit(words))).withColumn("_hash", F.xxhash64(F.lit(1), by)).withColumn("_mask", F.expr(mask))

    bits = marked(ids.select(by).where(F.col(by).isNotNull())).groupBy("_word").agg(F.bit_or("_mask").alias("_bits"))
    return marked(rows).join(F.broadcast(bits), "_word").where("_bits & _mask = _mask").select(rows.columns)


def uncollected(run: Callable) -> Callable:
    """A kernel over batches with cyclic collection off (many small objects, no cycles), on again for the worker's next task."""

    def inner(batches):
        gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()

    return inner


def mapped_rows(docs: DataFrame, run: Callable, result: StructField, rewrite: bool = False) -> DataFrame:
    """(row, result): each row of `docs` as a struct, whatever its columns are called, and what `run` makes of its text.

    `run()` makes, once a task, a function from a list of texts (null ones are
    None) to new texts and an array of results; `result` is its field, named
    "result". With `rewrite` the row's text becomes the new one.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index("text")

    def over(batches):
        step = run()
        for batch in batches:
            texts, values = step(batch.column(at).to_pylist())
            columns = [pa.array(texts, pa.string()) if i == at and rewrite else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, values], names=[*batch.schema.names, "result"])

    out = plain.mapInArrow(uncollected(over), StructType([*plain.schema.fields, result]))
    return out.select(F.struct(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)]).alias("row"), "result")


def doc_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a null text as the empty one; other columns, whatever their names, go."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
