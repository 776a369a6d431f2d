"""The subpackage's queries by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op7_bpe_roundtrip
from .lines import OP3_SQL, op3_line_dedup
from .minhash import OP10_SQL, op10_near_duplicates
from .packing import op1_pack
from .quality import OP2_SQL, op2_quality
from .secrets import op8_secrets
from .substrings import OP6_SQL, op6_repeats
from .toxicity import op5_toxicity
from .urls import OP9_SQL, op9_url_filter
from .vptree import OP4_SQL, op4_nearest


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pack": op1_pack,
        "op2_quality": op2_quality,
        "op3_line_dedup": op3_line_dedup,
        "op4_nearest": op4_nearest,
        "op5_toxicity": op5_toxicity,
        "op6_repeats": op6_repeats,
        "op7_bpe_roundtrip": op7_bpe_roundtrip,
        "op8_secrets": op8_secrets,
        "op9_url_filter": op9_url_filter,
        "op10_near_duplicates": op10_near_duplicates,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_quality": OP2_SQL, "op3_line_dedup": OP3_SQL, "op4_nearest": OP4_SQL, "op6_repeats": OP6_SQL, "op9_url_filter": OP9_SQL, "op10_near_duplicates": OP10_SQL}
