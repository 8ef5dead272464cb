"""The text operators' queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import op5_chat_formatting
from .decontaminate import OP6_SQL, op6_decontamination
from .hamming_search import OP9_SQL, op9_hamming_search
from .html_extract import op10_html_extraction
from .mixing import op2_source_mixing
from .simhash import op3_simhash_near_dedup
from .suffix_dedup import op4_suffix_dedup
from .token_output import op1_token_output
from .toxicity import op7_toxicity
from .warc import op8_warc_derivatives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_output,
        op2_source_mixing,
        op3_simhash_near_dedup,
        op4_suffix_dedup,
        op5_chat_formatting,
        op6_decontamination,
        op7_toxicity,
        op8_warc_derivatives,
        op9_hamming_search,
        op10_html_extraction,
    )
}
ORACLE_SQL: dict[str, str] = {"op6_decontamination": OP6_SQL, "op9_hamming_search": OP9_SQL}
