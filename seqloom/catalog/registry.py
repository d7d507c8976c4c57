"""Named queries over the given tables, each with its SQL equivalent where one exists."""

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
