"""Corpus pipeline: toxicity, line dedup, near-dedup, secret scans, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. All but the last return the columns of `documents`; the
last returns pieces of packed sequences. `run` writes each stage's rows as
Parquet and rereads them as the next one's `docs`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm.common import staged, table
from tempora.llm.lines import deduplicated_rows
from tempora.llm.minhash import near_duplicates
from tempora.llm.packing import pack_digest
from tempora.llm.secrets import redacted_rows
from tempora.llm.toxicity import CUTOFF, score_rows, train


def _rows(changed: DataFrame, like: DataFrame) -> DataFrame:
    """The structs in `row` as columns again, `n_chars` counted anew."""
    n_chars = F.length("row.text").cast("long").alias("n_chars")
    return changed.select(*[n_chars if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in like.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose score stays below the cutoff."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_rows(docs, model).where(F.col("result") < CUTOFF).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated line runs from the texts; every document stays."""
    return _rows(deduplicated_rows(docs), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each near-duplicate group."""
    kept = near_duplicates(docs).where("kept").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").select(docs.columns)
    return named.unionByName(docs.where("doc_id is null"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret found by a mark."""
    return _rows(redacted_rows(docs), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences of at most 2048 tokens."""
    return pack_digest(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: SQL cannot express the trained classifier; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
