"""Every query of the engine with its SQL twin."""

from __future__ import annotations


def _modules():
    from kinograph.plans import checks, coverage, entries, geometry, jobs, mosaics, overlay, parts, quality, records, segments, service, shots, streams, tiles

    return overlay, coverage, tiles, quality, shots, parts, jobs, geometry, streams, records, checks, entries, service, mosaics, segments


def queries() -> dict:
    """name -> callable(spark, sf_dir)."""
    return {name: query for module in _modules() for name, query in module.QUERIES.items()}


def oracle_sql() -> dict:
    """name -> DuckDB SQL over the same tables."""
    return {name: text for module in _modules() for name, text in module.ORACLES.items()}
