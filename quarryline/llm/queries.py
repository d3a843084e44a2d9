"""Registered queries of this folder."""

from __future__ import annotations

from quarryline.llm import q_leaks, q_lines, q_markup, q_mixing, q_names, q_pairs, q_pieces, q_quality, q_ranks, q_scans

_PARTS = (q_ranks, q_lines, q_pairs, q_markup, q_pieces, q_scans, q_names, q_leaks, q_mixing, q_quality)

QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
