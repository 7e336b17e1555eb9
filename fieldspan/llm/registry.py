"""The queries of this subpackage and their oracle SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldspan.llm import ann, chat, langid, licenses, mixing, packing, pii, simhash, topk, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": packing.op1_packing,
    "op2_pii": pii.op2_pii,
    "op3_ann": ann.op3_ann,
    "op4_simhash": simhash.op4_simhash,
    "op5_langid": langid.op5_langid,
    "op6_mixing": mixing.op6_mixing,
    "op7_topk": topk.op7_topk,
    "op8_licenses": licenses.op8_licenses,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_chat": chat.op10_chat,
}
ORACLE_SQL: dict[str, str] = {"op6_mixing": mixing.ORACLE, "op7_topk": topk.ORACLE, "op8_licenses": licenses.ORACLE, "op10_chat": chat.ORACLE}
