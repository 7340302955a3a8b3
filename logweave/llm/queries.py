"""Queries of this subpackage and their SQL, for the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op4_bpe
from .dart_minhash import op2_near_dedup
from .hash_forest import op5_hash_forest
from .minhash import minhash_near_duplicates, op10_fingerprints
from .mixing import op8_mixing
from .oracles import MINHASH_SQL, OP2_SQL, OP6_SQL, OP9_SQL
from .secret_scan import op9_secret_scan
from .subword import op1_quality
from .suffix_dedup import op6_suffix_dedup
from .toxicity import op7_toxicity
from .warc import OP3_SQL, op3_warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_quality": op1_quality,
        "op2_near_dedup": op2_near_dedup,
        "op3_warc": op3_warc,
        "op4_bpe": op4_bpe,
        "op5_hash_forest": op5_hash_forest,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_toxicity": op7_toxicity,
        "op8_mixing": op8_mixing,
        "op9_secret_scan": op9_secret_scan,
        "op10_fingerprints": op10_fingerprints,
        "minhash_near_duplicates": minhash_near_duplicates,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_near_dedup": OP2_SQL, "op3_warc": OP3_SQL, "op6_suffix_dedup": OP6_SQL, "op9_secret_scan": OP9_SQL, "minhash_near_duplicates": MINHASH_SQL}
