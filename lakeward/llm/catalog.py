"""Queries of the training-data operators and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, jaccardjoin, mixing, resampling, secretscan, suffixdedup, tiff, tokenfiles, toxicity, urlfilter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_importance_resampling": resampling.op1_importance_resampling,
    "op2_secret_scan": secretscan.op2_secret_scan,
    "op3_suffix_dedup": suffixdedup.op3_suffix_dedup,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_tiff_media": tiff.op6_tiff_media,
    "op7_token_files": tokenfiles.op7_token_files,
    "op8_toxicity_chain": toxicity.op8_toxicity_chain,
    "op9_jaccard_join": jaccardjoin.op9_jaccard_join,
    "op10_url_filter": urlfilter.op10_url_filter,
}

ORACLES: dict[str, str] = {
    "op4_mix_sources": mixing.oracle(),
}
