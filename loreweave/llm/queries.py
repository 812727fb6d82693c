"""The queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from loreweave.llm import alignment, ann, decontam, interaction, linededup, lm, mixing, quality, secrets, simhash, sitestyle, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": quality.op1,
    "op2_line_dedup": linededup.op2,
    "op3_mix_sources": mixing.op3,
    "op4_nearest_neighbours": ann.op4,
    "op5_simhash_near_duplicates": simhash.op5,
    "op6_toxicity": toxicity.op6,
    "op7_decontaminate": decontam.op7,
    "op8_warc_bundles": warc.op8,
    "op9_lm_scoring": lm.op9,
    "op10_secret_scan": secrets.op10,
    "op11_tokenizer_alignment": alignment.op11,
    "op12_html_extraction": sitestyle.op12,
    "op13_filter_interactions": interaction.op13,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op2_line_dedup": linededup.ORACLE,
    "op3_mix_sources": mixing.ORACLE,
    "op7_decontaminate": decontam.ORACLE,
    "op8_warc_bundles": warc.ORACLE,
    "op13_filter_interactions": interaction.ORACLE,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    known = dict(ORACLES)
    if corpus_pipeline.ORACLE_SQL:
        known["pipeline"] = corpus_pipeline.ORACLE_SQL
    return known
