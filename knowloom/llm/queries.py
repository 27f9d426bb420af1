"""The training-data operators' queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontam import OP5_SQL, op5_decontaminate
from .langid import op6_language_id
from .mixing import op1_source_mix
from .neardup import OP8_SQL, op8_near_duplicates
from .pii import op4_personal_data
from .rollups import op9_token_counts
from .topk import OP10_SQL, op10_exact_topk
from .toxicity import op7_toxicity
from .unitdedup import op3_substring_dedup
from .warc import OP2_SQL, op2_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_source_mix, op2_warc, op3_substring_dedup, op4_personal_data, op5_decontaminate,
        op6_language_id, op7_toxicity, op8_near_duplicates, op9_token_counts, op10_exact_topk,
    )
}

ORACLE_SQL: dict[str, str] = {"op2_warc": OP2_SQL, "op5_decontaminate": OP5_SQL, "op8_near_duplicates": OP8_SQL, "op10_exact_topk": OP10_SQL}
