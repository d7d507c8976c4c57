"""Queries of this subpackage and their SQL equivalents."""

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
