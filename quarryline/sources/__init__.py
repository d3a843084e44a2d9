"""Table, JSON and CSV readers."""

from quarryline.sources.tables import read_table

__all__ = ["read_table"]
