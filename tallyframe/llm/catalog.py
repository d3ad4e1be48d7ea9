"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

import importlib

QUERIES, ORACLES = {}, {}

for _name in ("q_conversations", "q_documents", "q_pages"):
    _module = importlib.import_module(f"tallyframe.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
