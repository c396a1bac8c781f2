"""Driver query plans. Importing the modules registers their queries."""

from __future__ import annotations

import importlib

PLAN_MODULES = (
    "offerlake.plans.market_queries",
    "offerlake.plans.extract_queries",
    "offerlake.plans.profile_queries",
    "offerlake.plans.model_queries",
    "offerlake.plans.io_queries",
    "offerlake.plans.built_queries",
)


def load_all():
    for m in PLAN_MODULES:
        importlib.import_module(m)
    from offerlake.plans.registry import ORACLES, QUERIES
    return QUERIES, ORACLES
