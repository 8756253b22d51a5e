"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import anisotropic_search, bpe_tree, jaccard_join, language_mix, lattice_lm, mix_schedule, preference_format, rank_bpe, spelling_variants, token_alignment, token_files, toxicity, webp_lossless

_MODULES = (token_files, lattice_lm, language_mix, mix_schedule, jaccard_join, preference_format, anisotropic_search, toxicity, bpe_tree, webp_lossless, token_alignment, rank_bpe, spelling_variants)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLES.items()}
