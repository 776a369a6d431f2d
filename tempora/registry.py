"""All queries of the engine by name, with the SQL that checks them."""

from __future__ import annotations

from .plans import columns, core, files, kernels, pipelines, rasters, series, tables  # noqa: F401 - importing registers

FLAGSHIP = "rake_global"


def queries() -> dict:
    return dict(core.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(core.SQL)
