"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import op13_alignment
from .ann import op9_nearest
from .bpe import op10_bpe
from .licenses import op5_licenses
from .minhash import OP6_SQL, op6_near_duplicates
from .mixing import OP8_SQL, op8_mixing
from .packing import op11_packing
from .quality import op1_quality
from .ranked import OP12_SQL, op12_ranked
from .repeats import op3_repeats
from .rules import op7_rules
from .secret_scan import op4_secrets
from .token_counts import op2_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_token_counts": op2_token_counts,
    "op3_repeats": op3_repeats,
    "op4_secrets": op4_secrets,
    "op5_licenses": op5_licenses,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_rules": op7_rules,
    "op8_mixing": op8_mixing,
    "op9_nearest": op9_nearest,
    "op10_bpe": op10_bpe,
    "op11_packing": op11_packing,
    "op12_ranked": op12_ranked,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op6_near_duplicates": OP6_SQL,
    "op8_mixing": OP8_SQL,
    "op12_ranked": OP12_SQL,
}
