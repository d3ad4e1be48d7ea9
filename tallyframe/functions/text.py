"""Corpus text functions. Everything is native except Unicode NFC, for which Spark has no built-in."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# White space (as str.split sees it), typographic characters and their plain forms.
SPACE = r" \t\n\x0B\f\r\x1c-\x1f\x{85}\p{Z}"
TYPOGRAPHY = (("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "--"))


@pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def plain_typography(text: Column) -> Column:
    out = F.translate(text, "".join(a for a, b in TYPOGRAPHY if len(b) == 1),
                      "".join(b for _, b in TYPOGRAPHY if len(b) == 1))
    for fancy, plain in TYPOGRAPHY:
        if len(plain) > 1:
            out = F.replace(out, F.lit(fancy), F.lit(plain))
    return out


def normalize_unicode(text: Column) -> Column:
    """NFC (the only step that needs Python, Arrow-batched), then plain quotes and dashes."""
    return plain_typography(_nfc(text))


def strip_control(text: Column, keep_newline: bool = True) -> Column:
    """Tab becomes a blank; control, format, surrogate and unassigned characters go."""
    tabless = F.translate(text, "\t", " ")
    return F.regexp_replace(tabless, r"[\p{C}&&[^\n]]" if keep_newline else r"\p{C}", "")


def strip_blank(text: Column) -> Column:
    """Trim all leading and trailing white space."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def squeeze_blank(text: Column, preserve_newlines: bool = True) -> Column:
    out = F.regexp_replace(text, "[ \\t]+", " ")
    if not preserve_newlines:
        out = F.regexp_replace(out, "\\n+", "\n")
    return strip_blank(out)


def bound_lines(text: Column, min_len: int = 0, max_len: int = 0) -> Column:
    """Drop short lines, cut long ones; 0 switches a bound off."""
    lines = F.split(text, "\n", -1)
    if min_len:
        lines = F.filter(lines, lambda x: F.length(x) >= min_len)
    if max_len:
        lines = F.transform(lines, lambda x: F.substring(x, 1, max_len))
    return F.array_join(lines, "\n")


def clean(text: Column, preserve_newlines: bool = True, min_line_len: int = 0, max_line_len: int = 0,
          nfc: bool = True) -> Column:
    out = normalize_unicode(text) if nfc else plain_typography(text)
    out = squeeze_blank(strip_control(out, preserve_newlines), preserve_newlines)
    if min_line_len or max_line_len:
        out = bound_lines(out, min_line_len, max_line_len)
    return strip_blank(out)


def characters(text: Column) -> Column:
    """Array of characters ('' gives an empty array). The split alone yields one element a character, only that of the empty text
    is empty; a filter over all characters would be a lambda call for each."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+"), F.lit(0))


def word_ngrams(items: Column, n: int) -> Column:
    """All windows of n consecutive tokens, joined by a blank. Built from n shifted arrays, so the cost is linear in the length."""
    last = F.greatest(F.size(items) - (n - 1), F.lit(0))
    out = F.slice(items, F.lit(1), last)
    for shift in range(1, n):
        out = F.zip_with(out, F.slice(items, F.lit(shift + 1), last), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def char_ngrams(text: Column, n: int) -> Column:
    """All n-character substrings. Each match takes one character and shows the n from there on: one pass without a lambda."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))
