"""The registered queries, one module per group of operators."""

from importlib import import_module

from corpuslink.queries.registry import ORACLES, QUERIES

MODULES = ("corpus", "graph", "entries", "text", "search", "relations", "raters", "chains", "meaning", "tables")

for _name in MODULES:
    import_module(f"corpuslink.queries.{_name}")

__all__ = ["QUERIES", "ORACLES"]
