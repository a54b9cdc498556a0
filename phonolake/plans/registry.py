"""All queries of the library and their SQL."""

from __future__ import annotations

from ..session import ship
from . import catalog_queries, classifier_queries, model_queries, record_queries, report_queries, row_queries, rule_queries, scoring_queries, set_queries, signal_queries, text_queries, track_queries

_modules = (catalog_queries, row_queries, text_queries, scoring_queries, rule_queries, report_queries, record_queries, signal_queries, track_queries, classifier_queries, model_queries, set_queries)


def _shipped(f):
    def run(spark, sf_dir):
        return f(ship(spark), sf_dir)

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


QUERIES = {name: _shipped(f) for m in _modules for name, f in m.Q.items()}
ORACLE_SQL = {name: sql for m in _modules for name, sql in m.SQL.items() if sql}
FLAGSHIP = QUERIES["phone_profile"]
