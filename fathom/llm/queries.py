"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import importlib

#: Modules with a query of an operator each; a query module has NAME, query and ORACLE_SQL.
MODULES = ("q01_urls", "q02_quality", "q03_bpe", "q04_decontaminate", "q05_suffixes", "q06_pii", "q07_toxicity", "q08_media", "q09_warc", "q10_jaccard", "q11_centroids", "q12_minhash", "q13_panes")


def _modules():
    return [importlib.import_module(f"fathom.llm.{m}") for m in MODULES]


def queries() -> dict:
    return {m.NAME: m.query for m in _modules()}


def oracle_sql() -> dict:
    return {m.NAME: m.ORACLE_SQL for m in _modules() if m.ORACLE_SQL}
