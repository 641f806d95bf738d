"""Operators that need more than one row: joins, aggregates, splits, matrices."""
