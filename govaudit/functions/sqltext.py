"""Small helpers for writing Spark SQL expressions.

Large expressions are written as SQL text: one parse instead of hundreds of
calls into the JVM while a plan is being built.
"""

from __future__ import annotations

from collections.abc import Iterable


def text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def texts(values: Iterable[str]) -> str:
    """An ARRAY<STRING> of literals."""
    return "array(" + ", ".join(text(v) for v in values) + ")"


def mapping(values: dict[str, str]) -> str:
    """A MAP<STRING,STRING> of literals."""
    return "map(" + ", ".join(f"{text(k)}, {text(v)}" for k, v in values.items()) + ")"


def bind(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def any_of(conditions: Iterable[str]) -> str:
    return "(" + " OR ".join(conditions) + ")"
