"""Registry of the named queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

FLAGSHIP = "curate_counts"
_QUERIES: dict[str, Callable] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: file a (spark, sf_dir) query under ``name``, with its DuckDB SQL if SQL can say it."""

    def put(fn):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if sql:
            _ORACLE[name] = sql
        return fn

    return put


def queries() -> dict[str, Callable]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)


from tesserae.plans import assay, choose, curate, evaluate, learn, networks, stream  # noqa: E402,F401
