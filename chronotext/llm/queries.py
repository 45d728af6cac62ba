"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

import importlib

_NAMES = ["near_dup", "cross_split", "splits", "sampling", "tokenizing", "mixing", "language"]
_MODULES = [importlib.import_module(f"chronotext.llm.{n}") for n in _NAMES]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
