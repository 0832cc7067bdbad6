"""Operators for preparing training text; nothing else in the library imports this package."""

from __future__ import annotations

import importlib

MODULES = ("problem_queries",)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in importlib.import_module(f"sedimenta.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in importlib.import_module(f"sedimenta.llm.{m}").SQL.items()}
