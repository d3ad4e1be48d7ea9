"""Small helpers for building SQL expression text. Wide generated expressions (record renderers, compiled checks) are
built as text and parsed once; building them Column by Column would cost one driver round trip per node."""

from __future__ import annotations

from collections.abc import Sequence


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def array(values: Sequence[str]) -> str:
    return "array(" + ", ".join(q(v) for v in values) + ")"


def in_list(values: Sequence[str]) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"
