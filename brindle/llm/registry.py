"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from brindle.llm.exact_dedup import OP9_SQL, op9_exact_dedup
from brindle.llm.langid import op8_language_id
from brindle.llm.mixing import op3_source_mixing
from brindle.llm.nn_descent import op7_nn_descent
from brindle.llm.packing import op10_best_fit_packing
from brindle.llm.sharding import op5_hilbert_sharding
from brindle.llm.simhash import op4_simhash_near_dedup
from brindle.llm.suffix_dedup import OP6_SQL, op6_suffix_dedup
from brindle.llm.url_filter import OP2_SQL, op2_url_filter
from brindle.llm.warc import OP1_SQL, op1_warc_index


def queries() -> dict:
    return {
        "op1_warc_index": op1_warc_index,
        "op2_url_filter": op2_url_filter,
        "op3_source_mixing": op3_source_mixing,
        "op4_simhash_near_dedup": op4_simhash_near_dedup,
        "op5_hilbert_sharding": op5_hilbert_sharding,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_nn_descent": op7_nn_descent,
        "op8_language_id": op8_language_id,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_best_fit_packing": op10_best_fit_packing,
    }


def oracle_sql() -> dict:
    return {"op1_warc_index": OP1_SQL, "op2_url_filter": OP2_SQL, "op6_suffix_dedup": OP6_SQL, "op9_exact_dedup": OP9_SQL}
