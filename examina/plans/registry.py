"""All registered queries of the library, with their oracles."""

from __future__ import annotations

from importlib import import_module

_PLANS = ("assess", "supervise", "evidence", "intake", "select", "publish", "files", "ledger", "nearness", "reach")
QUERIES, ORACLE = {}, {}
for _name in _PLANS:
    _plan = import_module(f"{__package__}.{_name}")
    QUERIES |= _plan.QUERIES
    ORACLE |= _plan.ORACLE
