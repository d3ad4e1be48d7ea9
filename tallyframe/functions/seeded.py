"""Deterministic pseudo-random values: each is a pure function of (seed, row id, field name).

A retried task therefore produces the same value, and partitions generate independently. All functions take SQL
expression text for the row id and return SQL expression text.
"""

from __future__ import annotations

from collections.abc import Sequence

from tallyframe.functions.sqltext import array, q


def digest(seed, row_id: str, field: str) -> str:
    return f"md5(concat_ws('|', {q(str(seed))}, cast({row_id} as string), {q(field)}))"


def u32(seed, row_id: str, field: str) -> str:
    """Uniform integer in [0, 2^32)."""
    return f"cast(conv(substring({digest(seed, row_id, field)}, 1, 8), 16, 10) as bigint)"


def unit(seed, row_id: str, field: str) -> str:
    """Uniform double in [0, 1)."""
    return f"({u32(seed, row_id, field)} / 4294967296D)"


def u60(seed, row_id: str, field: str) -> str:
    """Uniform integer in [0, 2^60)."""
    return f"cast(conv(substring({digest(seed, row_id, field)}, 1, 15), 16, 10) as bigint)"


def between(seed, row_id: str, field: str, low: int, high: int) -> str:
    """Uniform integer in [low, high]; ranges too wide for 32 bits take 60."""
    drawn = u32 if high - low < 1 << 24 else u60
    return f"({drawn(seed, row_id, field)} % {high - low + 1} + {low})"


def pick(seed, row_id: str, field: str, values: Sequence[str]) -> str:
    """One of the given values."""
    return f"element_at({array(values)}, cast({u32(seed, row_id, field)} % {len(values)} + 1 as int))"


def digits(seed, row_id: str, field: str, width: int) -> str:
    """Eight digits from each half of a digest, as the rest of a 60-bit number: even to one part in 10^10."""
    halves = [f"lpad(cast(cast(conv(substring({digest(seed, row_id, f'{field}#{i // 2}')}, {i % 2 * 16 + 1}, 15), 16, 10) as bigint) % 100000000 as string), 8, '0')"
              for i in range((width + 7) // 8)]
    return f"substring(concat({', '.join(halves)}), 1, {width})"


#: Base-64 symbols that do not stand for one of the alphabet's; those that are left are equally likely.
NOT_ALNUM, NOT_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ+/", "0123456789+/"


def blocks_for(width: int) -> int:
    """Digests whose 21 full base-64 symbols leave at least ``width`` after rejection, with many deviations to spare."""
    return width // 8 + 4


def _symbols(seed, row_id: str, field: str, width: int, rejected: str) -> str:
    blocks = [f"substring(base64(unhex({digest(seed, row_id, f'{field}#{i}')})), 1, 21)" for i in range(blocks_for(width))]
    return f"substring(upper(translate(concat({', '.join(blocks)}), '{rejected}', '')), 1, {width})"


def alnum(seed, row_id: str, field: str, width: int) -> str:
    """A-Z and 0-9, all equally likely."""
    return _symbols(seed, row_id, field, width, NOT_ALNUM)


def letters(seed, row_id: str, field: str, width: int) -> str:
    """A-Z, all equally likely."""
    return _symbols(seed, row_id, field, width, NOT_LETTERS)
