"""Quoting for expressions given as SQL text."""

from __future__ import annotations


def text_literal(value: str) -> str:
    """The value as a SQL string literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"
