"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plusminus.llm.language import op2_language
from plusminus.llm.packing import op7_packing
from plusminus.llm.quality import op3_quality
from plusminus.llm.secrets import op6_secrets
from plusminus.llm.simhash import op10_simhash
from plusminus.llm.substring_dedup import op9_substring_dedup
from plusminus.llm.suffix_pieces import op1_sentencepiece
from plusminus.llm.token_counts import op5_token_counts
from plusminus.llm.token_file import op4_token_file
from plusminus.llm.topk import OP8_SQL, op8_topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_sentencepiece, op2_language, op3_quality, op4_token_file, op5_token_counts, op6_secrets, op7_packing, op8_topk, op9_substring_dedup, op10_simhash]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op8_topk": OP8_SQL}
