"""The operators' queries, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from haulcost.llm.alignment import op11_cross_tokenizer_alignment
from haulcost.llm.codes import OP12_SQL, op12_vector_code_compression
from haulcost.llm.extraction import op13_html_extraction
from haulcost.llm.jaccard import op7_ngram_jaccard
from haulcost.llm.licenses import op1_license_scan
from haulcost.llm.lines import OP6_SQL, op6_line_dedup
from haulcost.llm.mixing import op3_mixing
from haulcost.llm.neighbours import OP9_SQL, op9_nearest_neighbours
from haulcost.llm.packing import op10_best_fit_packing
from haulcost.llm.quality import op4_quality_rules
from haulcost.llm.sharding import op5_sharding
from haulcost.llm.surrogates import op2_pii_surrogates
from haulcost.llm.warc import OP8_SQL, op8_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    operators = (
        op1_license_scan,
        op2_pii_surrogates,
        op3_mixing,
        op4_quality_rules,
        op5_sharding,
        op6_line_dedup,
        op7_ngram_jaccard,
        op8_warc,
        op9_nearest_neighbours,
        op10_best_fit_packing,
        op11_cross_tokenizer_alignment,
        op12_vector_code_compression,
        op13_html_extraction,
    )
    return {f.__name__: f for f in operators}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_line_dedup": OP6_SQL,
        "op8_warc": OP8_SQL,
        "op9_nearest_neighbours": OP9_SQL,
        "op12_vector_code_compression": OP12_SQL,
    }
