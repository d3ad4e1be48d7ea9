"""Joins of a large, possibly skewed table with a lookup that is unique on the key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def lookup_join(big: DataFrame, lookup: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Left-join ``values`` of ``lookup`` (unique on ``keys``). ``big`` is the outer side, so adaptive execution may cut its heavy
    partitions, one key's rows as well, and give every part the lookup's few rows: any number of hot keys, none of them a
    single task. A lookup that turns out to be small is broadcast by its measured size."""
    return big.join(lookup.select(*keys, *values), list(keys), "left")
