"""Loads every query module and exposes the registry."""

from __future__ import annotations

import importlib

from tallyframe.plans.registry import ORACLES, QUERIES

MODULES = ("q_files", "q_validate", "q_profile", "q_structure", "q_synth", "q_corpus", "q_audit")

for _name in MODULES:
    importlib.import_module(f"tallyframe.plans.{_name}")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
