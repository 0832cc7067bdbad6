"""All queries of the library's core, by name, with their SQL twins."""

from __future__ import annotations

import importlib

MODULES = ("problems", "usage_state", "text_code", "retrieval_ranking", "graphs", "streams", "assembly", "answering")


def queries() -> dict:
    return {k: v for m in MODULES for k, v in importlib.import_module(f"sedimenta.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in importlib.import_module(f"sedimenta.plans.{m}").SQL.items()}
