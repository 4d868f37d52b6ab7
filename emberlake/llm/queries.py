"""The queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberlake.llm import sql
from emberlake.llm.chat import op10_chat
from emberlake.llm.decontaminate import op5_decontaminate
from emberlake.llm.fingerprint import op8_fingerprint
from emberlake.llm.linkgraph import op1_url_filter
from emberlake.llm.mixing import OP6_SQL, op6_mixing
from emberlake.llm.neardup import op9_near_duplicates
from emberlake.llm.pii import op4_pii
from emberlake.llm.quality import op3_quality
from emberlake.llm.shared import table
from emberlake.llm.sitetree import op7_html
from emberlake.llm.suffix import op2_suffix


def _on(operator: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(*(table(spark, sf_dir, t) for t in tables))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": _on(op1_url_filter, "pages"),
        "op2_suffix": _on(op2_suffix, "documents"),
        "op3_quality": _on(op3_quality, "documents", "labels"),
        "op4_pii": _on(op4_pii, "documents"),
        "op5_decontaminate": _on(op5_decontaminate, "documents", "benchmark"),
        "op6_mixing": _on(op6_mixing, "documents"),
        "op7_html": _on(op7_html, "pages"),
        "op8_fingerprint": _on(op8_fingerprint, "documents"),
        "op9_near_duplicates": _on(op9_near_duplicates, "documents"),
        "op10_chat": _on(op10_chat, "conversations"),
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": sql.URL_FILTER, "op5_decontaminate": sql.DECONTAMINATE, "op6_mixing": OP6_SQL, "op9_near_duplicates": sql.NEAR_DUPLICATES, "op10_chat": sql.CHAT}
