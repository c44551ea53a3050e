"""The registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

import functools
import textwrap
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakesync.llm import (
    bpe, collocations, line_rules, main_text, mixing, near_dedup, order_minhash, ppm, ranked_search, sharding, toxicity, transcripts,
    url_rules,
)
from lakesync.session import set_runtime_defaults

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {
    "op1_main_text": main_text.op1_main_text,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_ppm": ppm.op4_ppm,
    "op5_line_rules": line_rules.op5_line_rules,
    "op6_transcripts": transcripts.op6_transcripts,
    "op7_bpe": bpe.op7_bpe,
    "op8_order_minhash": order_minhash.op8_order_minhash,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_reshard": sharding.op10_reshard,
    "op11_collocations": collocations.op11_collocations,
    "op12_url_rules": url_rules.op12_url_rules,
    "op13_ranked_search": ranked_search.op13_ranked_search,
}
_ORACLES = {"op5_line_rules": line_rules.SQL5, "op9_mix_sources": mixing.SQL9,
            "op11_collocations": collocations.SQL11, "op12_url_rules": url_rules.SQL12, "op13_ranked_search": ranked_search.SQL13}


def _with_defaults(function: Query) -> Query:
    @functools.wraps(function)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        set_runtime_defaults(spark)
        return function(spark, sf_dir)

    return run


def all_queries() -> dict[str, Query]:
    return {name: _with_defaults(function) for name, function in _QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: textwrap.dedent(sql).strip() for name, sql in _ORACLES.items()}
