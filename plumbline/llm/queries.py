"""All queries of this subpackage with, where SQL can say the same, their DuckDB text."""

from importlib import import_module

from .common import ORACLE, QUERIES

MODULES = ["ann", "neardup", "langid", "quality", "licenses", "chat", "bpe", "token_store", "repeats", "decontam", "collocations", "merkle", "topk"]


def _load():
    for name in MODULES:
        import_module(f"{__package__}.{name}")


def all_queries():
    _load()
    return QUERIES


def all_oracles():
    _load()
    return ORACLE
