"""Fixed-width and delimited slicing and rendering (SQL expression text), naming and classification (Columns)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from tallyframe.functions.sqltext import q


def slice_field(line: str, start: int, end: int) -> str:
    """1-based inclusive slice; a slice that runs past the line is empty."""
    return f"if(length({line}) >= {end}, substring({line}, {start}, {end - start + 1}), '')"


def fit(value: str, width: int, justify: str = "left", pad: str | None = None) -> str:
    """Cut to width, then justify with the pad character."""
    side, fill = ("lpad", pad or "0") if justify == "right" else ("rpad", pad or " ")
    return f"{side}(coalesce(cast({value} as string), ''), {width}, {q(fill)})"


def render_fixed(parts: Sequence[tuple[int, int, str]], record_length: int) -> str:
    """Place already fitted (start, end, value) parts in a blank record."""
    pieces, at = [], 1
    for start, end, value in sorted(parts, key=lambda p: p[0]):
        if start > at:
            pieces.append(q(" " * (start - at)))
        pieces.append(value)
        at = end + 1
    if at <= record_length:
        pieces.append(q(" " * (record_length - at + 1)))
    return f"concat({', '.join(pieces)})"


def render_delimited(values: Sequence[str], delimiter: str) -> str:
    trimmed = ", ".join(f"coalesce(trim(cast({v} as string)), '')" for v in values)
    return f"concat_ws({q(delimiter)}, {trimmed})"


def regex_quote(text: str) -> str:
    return "".join("\\" + ch if ch in r"\.[]{}()*+-?^$|/" else ch for ch in text)


def split_field(line: str, delimiter: str, position: int) -> str:
    """Plain split, 1-based; a missing position is the empty string."""
    return f"coalesce(try_element_at(split({line}, {q(regex_quote(delimiter))}, -1), {position}), '')"


def snake_name(raw: Column) -> Column:
    """Column header to snake_case field name."""
    joined = F.regexp_replace(F.lower(F.trim(raw)), r"[\s\-/]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(joined, "[^a-z0-9_]", ""), F.lit("")), F.lit("unknown_field"))


def spec_name(raw: Column) -> Column:
    """Free text to UPPER_SNAKE spec field name; outer blanks, underscores and hyphens go."""
    stripped = F.regexp_replace(F.upper(F.trim(raw)), r"^[_\-]+|[_\-]+$", "")
    return F.regexp_replace(stripped, r"\s+", "_")


def mask_password(url: Column) -> Column:
    """Hide the password part of user:password@host."""
    return F.regexp_replace(url, r"(:)[^:@]+(@)", "$1****$2")


def safe_table_name(raw: Column) -> Column:
    return F.regexp_replace(raw, r"[^A-Za-z0-9_.]", "")


def safe_file_name(raw: Column) -> Column:
    """Last path component with only letters, digits, hyphen, underscore and dot."""
    name = F.regexp_replace(F.regexp_extract(raw, r"([^/]*)/*$", 1), r"[^\p{L}\p{N}\-_.]", "")
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("upload.bin"))


def safe_spec_name(raw: Column) -> Column:
    return F.regexp_replace(raw, r"[^A-Za-z0-9_\-]", "_")


def classify(line: Column, record_types: Sequence[str], padding: str | None = None) -> Column:
    """Record type of a line: one character, then two, then a known upper-case prefix; null when unmatched."""
    types = list(record_types)
    upper = F.upper(line)
    options = []
    if padding is not None:
        options.append(F.when(line == padding, F.lit("padding")))
    options.append(F.when(F.substring(line, 1, 1).isin(types), F.substring(line, 1, 1)))
    options.append(F.when((F.length(line) >= 2) & F.substring(line, 1, 2).isin(types), F.substring(line, 1, 2)))
    options += [F.when(upper.startswith(t), F.lit(t)) for t in types if len(t) > 2]
    return F.coalesce(*options)


def learned_record_id(line: Column, ach: bool) -> Column:
    """Record id used while learning: two characters for an ACH file, else the first digit or '0'."""
    if ach:
        return F.trim(F.substring(line, 1, 2))
    first = F.substring(line, 1, 1)
    return F.when(first.rlike("^[0-9]$"), first).otherwise(F.lit("0"))
