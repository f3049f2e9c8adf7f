"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riverstone.llm import chat_format, decontamination, exact_dedup, filter_audit, language_id, lexical_search, near_dedup, packing, quality, simhash, suffix_dedup, token_rollup, warc

MODULES = (chat_format, suffix_dedup, language_id, decontamination, packing, quality, exact_dedup, warc, token_rollup, near_dedup, simhash, filter_audit, lexical_search)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {m.NAME: m.query for m in MODULES}


def llm_oracles() -> dict[str, str]:
    return {m.NAME: m.ORACLE_SQL for m in MODULES if getattr(m, "ORACLE_SQL", None)}
