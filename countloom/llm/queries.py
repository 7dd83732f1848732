"""The queries of this folder, as ``__spark_entry__.py`` registers them."""

from __future__ import annotations

from countloom.llm.bpe import op8_bpe
from countloom.llm.decontaminate import op6_decontaminate
from countloom.llm.exact_dedup import OP5_SQL, op5_exact_dedup
from countloom.llm.merkle import OP13_SQL, op13_merkle
from countloom.llm.quality import op2_quality
from countloom.llm.reshard import op9_reshard
from countloom.llm.simhash import op3_simhash
from countloom.llm.surrogates import op10_surrogates
from countloom.llm.token_counts import op1_token_counts
from countloom.llm.toxicity import op12_toxicity
from countloom.llm.url_filter import OP7_SQL, op7_url_filter
from countloom.llm.warc import OP4_SQL, op4_warc
from countloom.llm.whiten import op11_whiten

_ALL = (
    op1_token_counts, op2_quality, op3_simhash, op4_warc, op5_exact_dedup, op6_decontaminate, op7_url_filter, op8_bpe, op9_reshard, op10_surrogates,
    op11_whiten, op12_toxicity, op13_merkle,
)
QUERIES = {f.__name__: f for f in _ALL}
#: The others can't be put in SQL; ``tests/llm`` holds them against brute force.
ORACLE_SQL = {"op4_warc": OP4_SQL, "op5_exact_dedup": OP5_SQL, "op7_url_filter": OP7_SQL, "op13_merkle": OP13_SQL}
