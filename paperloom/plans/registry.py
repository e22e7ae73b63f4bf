"""Queries over the tables, each with its SQL equivalent where there is one."""

from __future__ import annotations

from . import closeness, feeding, items, lists, more, questions, repairing, running, star, views

_ALL = items.QUERIES | star.QUERIES | views.QUERIES | lists.QUERIES | more.QUERIES | closeness.QUERIES | running.QUERIES | questions.QUERIES | repairing.QUERIES | feeding.QUERIES
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLE_SQL = {name: sql.strip() for name, (_, sql) in _ALL.items() if sql}
FLAGSHIP = items.composite_topk
