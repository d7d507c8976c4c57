from seqloom.catalog import aggregates, alignment, files, filters, joins, metrics, motifs, scalars, sets, similarity, splits, windows  # noqa: F401
from seqloom.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
