"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

import functools
import importlib

from orrery.llm.store import on_workers

#: Module and query of each operator.
OPERATORS = [
    ("near_dedup", "op1_minhash_dedup"),
    ("decontaminate", "op4_decontaminate"),
    ("packing", "op2_pack_sequences"),
    ("token_counts", "op3_token_counts"),
    ("language_id", "op5_language_id"),
    ("chat_format", "op6_chat_format"),
    ("media", "op7_webp_media"),
    ("suffix_dedup", "op10_suffix_dedup"),
    ("sharding", "op8_jump_sharding"),
    ("license_scan", "op9_license_scan"),
]


def visible(function):
    """The function, with this package made importable for Python workers first."""

    @functools.wraps(function)
    def run(spark, *rest):
        on_workers(spark)
        return function(spark, *rest)

    return run


def queries() -> dict:
    return {name: visible(getattr(importlib.import_module(f"orrery.llm.{module}"), name)) for module, name in OPERATORS}


def oracle_sql() -> dict[str, str]:
    found = {}
    for module, name in OPERATORS:
        sql = getattr(importlib.import_module(f"orrery.llm.{module}"), "ORACLE_SQL", None)
        if sql:
            found[name] = sql
    return found
