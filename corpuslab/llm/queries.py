"""Importing this module registers every query of the subpackage."""

from importlib import import_module

from .registry import ORACLE, QUERIES

for _m in ["q_langid", "q_bpe", "q_mixing", "q_partenum", "q_chat", "q_pii", "q_fingerprint", "q_linededup", "q_quality", "q_htmltext",
           "q_collocation", "q_periodic", "q_licences"]:
    import_module(f"{__package__}.{_m}")

__all__ = ["QUERIES", "ORACLE"]
