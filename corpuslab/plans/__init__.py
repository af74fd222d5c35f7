"""Named queries (the catalogue behind ``__spark_entry__``) and end-to-end plans."""

from importlib import import_module

from .registry import DESCRIPTIONS, ORACLE, QUERIES

_MODULES = ["q_prep", "q_split", "q_vocab", "q_metrics", "q_text", "q_math", "q_models", "q_explain", "q_io", "q_jobs"]


def load_all():
    for m in _MODULES:
        import_module(f"{__name__}.{m}")
    return QUERIES, ORACLE


__all__ = ["QUERIES", "ORACLE", "DESCRIPTIONS", "load_all"]
