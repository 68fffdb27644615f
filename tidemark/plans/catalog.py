"""All queries outside the llm package."""

from __future__ import annotations

from importlib import import_module

from . import registry

for _m in ("scans", "expressions", "companies", "joins", "aggregates", "windows", "temporal", "entities", "modelling", "reports"):
    import_module(f"{__package__}.{_m}")


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
