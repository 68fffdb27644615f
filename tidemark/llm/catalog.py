"""All queries of this package."""

from __future__ import annotations

from importlib import import_module

MODULES = ("secrets", "bpe", "packing", "langid", "quality", "pii", "warc", "media", "jaccard", "substrings")


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"{__package__}.{m}").ORACLES.items()}
